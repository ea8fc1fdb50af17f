"""Barcode counting over sequencing reads, expressed as Spark plans."""
