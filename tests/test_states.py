import pyarrow as pa
import pytest

from seqtally.operators.handlers import StateHandler
from seqtally.sources.fastq import read_fastq, read_fastq_pairs, read_fastq_ranges


def handlers():
    """Classes of a function travel by value: workers can't import a test."""

    class Joined(StateHandler):
        """All names and first bases in order: a state that knows if anything is out of place."""

        schema, names = "n long, text string", True

        def initialize(self):
            return []

        def process(self, state, batch):
            cols = [batch.column(c).to_pylist() for c in batch.schema.names]
            return state + ["/".join(x[:6] for x in r) for r in zip(*cols, strict=True)]

        def reduce(self, earlier, later):
            return earlier + later

        def finish(self, state):
            return pa.table({"n": [len(state)], "text": [" ".join(state)]})

    class Bases(StateHandler):
        schema = "base string, n long"

        def initialize(self):
            return {}

        def process(self, state, batch):
            assert batch.schema.names == ["seq"]
            for s in batch.column("seq").to_pylist():
                for c in s:
                    state[c] = state.get(c, 0) + 1
            return state

        def reduce(self, earlier, later):
            return {c: earlier.get(c, 0) + later.get(c, 0) for c in earlier | later}

        def finish(self, state):
            return pa.table({"base": pa.array(sorted(state), pa.string()), "n": pa.array([state[c] for c in sorted(state)], pa.int64())})

    return Joined, Bases


@pytest.fixture
def files(tmp_path):
    for side in ("one", "two"):
        (tmp_path / side).mkdir()
        for lane in range(3):
            (tmp_path / side / f"l{lane}.fastq").write_text("".join(f"@{side[0]}{lane}.{i}\n{'ACGT'[i % 4] * (i % 7 + 1)}\n+\n{'!' * (i % 7 + 1)}\n" for i in range(100 * lane)))
    return tmp_path


def test_states_are_merged_in_order(spark, files):
    want = [f"o{lane}.{i}"[:6] + "/" + ("ACGT"[i % 4] * (i % 7 + 1))[:6] for lane in range(3) for i in range(100 * lane)]
    Joined, _ = handlers()
    for fan in (2, 32):
        h = Joined()
        h.FAN = fan
        df = read_fastq_ranges(spark, str(files / "one"), 300)
        assert df.rdd.getNumPartitions() > 10
        assert [tuple(r) for r in h.plan(df).collect()] == [(300, " ".join(want))]


def test_pairs_and_sums(spark, files):
    Joined, Bases = handlers()
    pairs = read_fastq_pairs(spark, str(files / "one"), str(files / "two"), 500)
    row = Joined().plan(pairs).first()
    assert row.n == 300 and row.text.startswith("o1.0/t1.0/A/A o1.1/t1.1/CC/CC") and row.text.endswith("o2.199/t2.199/TTTT/TTTT")
    got = dict(tuple(r) for r in Bases().plan(read_fastq(spark, str(files / "one"))).collect())
    assert got == {c: sum(i % 7 + 1 for lane in range(3) for i in range(100 * lane) if "ACGT"[i % 4] == c) for c in "ACGT"}


def test_no_reads(spark, files):
    Joined, Bases = handlers()
    df = read_fastq(spark, str(files / "one" / "l0.fastq"))
    assert [tuple(r) for r in Joined().plan(df).collect()] == [(0, "")] and Bases().plan(df).collect() == []
