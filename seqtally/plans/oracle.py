"""DuckDB SQL that finds the same results the slow way.

Reads on the reverse strand are turned round as a whole and scanned forward, distances come from hamming() over
joined constants, and every candidate is compared with every barcode.
"""

from __future__ import annotations

from seqtally.plans.synth import ASYMMETRIC_SQL, PAIRS_SQL, POOL1, POOL2, READS_SQL, bc1, bc2, bc3
from seqtally.plans.template import Template

POOLS = f"""pool1 as (select cast(i as integer) as idx, {bc1('i')} as seq from range({POOL1}) t(i)),
pool2 as (select cast(i as integer) as idx, {bc2('i')} as seq from range({POOL2}) t(i)),
pool3 as (select cast(i as integer) as idx, {bc3('i')} as seq from range(4) t(i))"""
BASE = f"reads as ({READS_SQL}), pairs as ({PAIRS_SQL}), odd as ({ASYMMETRIC_SQL}), {POOLS}"


def canon(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^ACGT]', 'N', 'g')"


def turned(x: str) -> str:
    return f"reverse(translate(upper({x}), 'ACGTRYKMBDHVNSW', 'TGCAYRMKVHDBNSW'))"


def scan(name: str, source: str, seq: str, text: str, k: int, strand: str, keep_raw: bool = False) -> list[str]:
    """CTE ``name``: read_id, reverse, position, cm, v0, v1, ..."""
    t, n = Template(text), len(text)
    sides = []
    if strand in ("forward", "both"):
        sides.append(f"select read_id, false as reverse, {seq} as s from {source}")
    if strand in ("reverse", "both"):
        sides.append(f"select read_id, true as reverse, {turned(seq)} as s from {source}")
    const = " || ".join(f"substr(upper(s), q + {a + 1}, {len(b)})" for a, b in t.segments())
    bases = "".join(b for _, b in t.segments())
    cut = [f"substr(s, q + {s + 1}, {e - s})" for s, e in t.regions]
    regions = ", ".join(f"{c if keep_raw else canon(c)} as v{i}" for i, c in enumerate(cut))
    return [
        f"{name}_s as ({' union all '.join(sides)})",
        f"{name}_q as (select read_id, reverse, s, unnest(range(0, length(s) - {n} + 1)) as q from {name}_s where length(s) >= {n})",
        f"{name} as (select * from (select read_id, reverse, cast(case when reverse then length(s) - {n} - q else q end as integer) as position, cast(hamming({const}, '{bases}') as integer) as cm, {regions} from {name}_q) where cm <= {k})",
    ]


def nearest(name: str, source: str, keys: str, v: str, pool: str, cap: str, duplicates: str) -> list[str]:
    """CTE ``name``: the rows of source with idx and d of the nearest barcode of pool, where there is one."""
    pick = {"first": "min(idx)", "last": "max(idx)"}.get(duplicates, "case when count(distinct idx) = 1 then min(idx) end")
    return [
        f"{name}_c as (select {keys}, {v} as vv, p.idx, cast(hamming({v}, p.seq) as integer) as d from {source} cross join {pool} p)",
        f"{name}_m as (select *, min(d) over (partition by {keys}) as least from {name}_c where d <= {cap})",
        f"{name} as (select * from (select {keys}, least as d, {pick} as idx from {name}_m where d = least group by {keys}, least) where idx is not null)",
    ]


def resolve(name: str, source: str, first: bool, idx: str = "idx") -> list[str]:
    """CTE ``name``: one row of source for each read; source has read_id, position, reverse, mm and idx columns."""
    if first:
        return [f"{name} as (select * exclude (rn) from (select *, row_number() over (partition by read_id order by position, reverse) as rn from {source}) where rn = 1)"]
    return [
        f"{name}_b as (select * from (select *, min(mm) over (partition by read_id) as least from {source}) where mm = least)",
        f"{name}_u as (select read_id from {name}_b group by read_id having count(distinct ({idx})) = 1)",
        f"{name} as (select * exclude (rn, least) from (select *, row_number() over (partition by read_id order by position, reverse) as rn from {name}_b where read_id in (select read_id from {name}_u)) where rn = 1)",
    ]


def single(name: str, source: str, seq: str, text: str, pool: str, k: int, first: bool, strand: str = "forward", duplicates: str = "error") -> list[str]:
    """CTE ``name``: read_id, idx, position, reverse, mm, d."""
    keys = "read_id, reverse, position, cm"
    return [
        *scan(f"{name}_h", source, seq, text, k, strand),
        *nearest(f"{name}_n", f"{name}_h", keys, "v0", pool, str(k), duplicates),
        f"{name}_t as (select read_id, idx, position, reverse, cm + d as mm, d from {name}_n where cm + d <= {k})",
        *resolve(name, f"{name}_t", first),
    ]


def combo(name: str, source: str, seq: str, text: str, pools: list[str], k: int, first: bool, strand: str = "forward", duplicates: str = "error") -> list[str]:
    """CTE ``name``: read_id, idx1, idx2, ..., position, reverse, mm."""
    n = len(pools)
    out = scan(f"{name}_h", source, seq, text, k, strand)
    for i, p in enumerate(pools):
        out += nearest(f"{name}_n{i}", f"{name}_h", "read_id, reverse, position, cm", f"v{i}", p, str(k), duplicates)
    joins = " ".join(f"join {name}_n{i} using (read_id, reverse, position, cm)" for i in range(1, n))
    total = " + ".join(["cm", *[f"{name}_n{i}.d" for i in range(n)]])
    idx = ", ".join(f"{name}_n{i}.idx as idx{i + 1}" for i in range(n))
    out.append(f"{name}_t as (select read_id, {idx}, position, reverse, {total} as mm from {name}_n0 {joins} where {total} <= {k})")
    return out + resolve(name, f"{name}_t", first, ", ".join(f"idx{i + 1}" for i in range(n)))


def dual(name: str, source: str, seq: str, text: str, pool: str, k: int, first: bool, strand: str = "forward", duplicates: str = "error") -> list[str]:
    keys = "read_id, reverse, position, cm"
    return [
        *scan(f"{name}_h", source, seq, text, k, strand),
        f"{name}_k as (select {keys}, v0 || v1 as v from {name}_h)",
        *nearest(f"{name}_n", f"{name}_k", keys, "v", pool, str(k), duplicates),
        f"{name}_t as (select read_id, idx, position, reverse, cm + d as mm, d from {name}_n where cm + d <= {k})",
        *resolve(name, f"{name}_t", first),
    ]


#: Valid pairs of the paired dual designs: 24 tuples.
TUPLES = "tuples as (select a.idx, a.seq as s1, b.seq as s2, a.seq || b.seq as seq from pool1 a join pool2 b on b.idx = a.idx % 12)"


def dual_paired(name: str, first: bool, random: bool, k1: int, k2: int, left: str, right: str, duplicates: str = "error", strands: tuple[str, str] = ("forward", "forward"), source: str = "pairs", tuples: str = "tuples") -> list[str]:
    """CTE ``name``: read_id, idx."""
    pick = {"first": "min(idx)", "last": "max(idx)"}.get(duplicates, "case when count(distinct idx) = 1 then min(idx) end")
    out, sides = [], [("o", "seq1", "seq2", 0), *([("w", "seq2", "seq1", 1)] if random else [])]
    for tag, a, b, _ in sides:
        out += scan(f"{name}_{tag}1", source, a, left, k1, strands[0]) + scan(f"{name}_{tag}2", source, b, right, k2, strands[1])
    parts = " union all ".join(f"select x.read_id, {s} as side, x.position as p1, y.position as p2, x.cm as c1, y.cm as c2, x.v0 as a, y.v0 as b from {name}_{t}1 x join {name}_{t}2 y using (read_id)" for t, _, _, s in sides)
    keys = "read_id, side, p1, p2, c1, c2"
    out += [
        f"{name}_c as ({parts})",
        f"{name}_d as (select {keys}, t.idx, cast(hamming(a, t.s1) as integer) as d1, cast(hamming(b, t.s2) as integer) as d2 from {name}_c cross join {tuples} t)",
        f"{name}_e as (select *, min(d1 + d2) over (partition by {keys}) as least from {name}_d where d1 <= {k1} - c1 and d2 <= {k2} - c2)",
        f"{name}_h as (select * from (select {keys}, c1 + c2 + least as mm, {pick} as idx from {name}_e where d1 + d2 = least group by {keys}, least) where idx is not null)",
    ]
    if first:
        out.append(f"{name} as (select read_id, idx from (select *, row_number() over (partition by read_id order by side, p1, p2) as rn from {name}_h) where rn = 1)")
        return out
    none = k1 + k2 + 1
    out += [
        f"{name}_l as (select * from (select *, min(mm) over (partition by read_id, side) as best from {name}_h) where mm = best)",
        f"{name}_b as (select read_id, side, best as mm, case when count(distinct idx) = 1 then min(idx) end as idx from {name}_l group by read_id, side, best)",
        f"{name}_x as (select r.read_id, x.idx as xi, coalesce(x.mm, {none}) as xm, y.idx as yi, coalesce(y.mm, {none}) as ym from (select distinct read_id from {name}_b) r left join {name}_b x on x.read_id = r.read_id and x.side = 0 left join {name}_b y on y.read_id = r.read_id and y.side = 1)",
    ]
    chosen = "case when xi is null or xm > ym then yi when xm = ym and xi is distinct from yi then null else xi end" if random else "xi"
    out.append(f"{name} as (select * from (select read_id, {chosen} as idx from {name}_x) where idx is not null)")
    return out


def combo_paired(name: str, source: str, first: bool, random: bool, k1: int, k2: int, left: str, right: str, duplicates: str = "error", strands: tuple[str, str] = ("forward", "forward")) -> list[str]:
    """CTE ``name``: read_id, kind, idx1, idx2."""
    out = single(f"{name}_m1", source, "seq1", left, "pool1", k1, first, strands[0], duplicates) + single(f"{name}_m2", source, "seq2", right, "pool2", k2, first, strands[1], duplicates)
    names = ["m1", "m2"]
    if random:
        out += single(f"{name}_n1", source, "seq2", left, "pool1", k1, first, strands[0], duplicates) + single(f"{name}_n2", source, "seq1", right, "pool2", k2, first, strands[1], duplicates)
        names += ["n1", "n2"]
    columns = ", ".join(f"{x}.idx as {x}, {x}.mm as {x}m" for x in names)
    joins = " ".join(f"left join {name}_{x} {x} on {x}.read_id = r.read_id" for x in names)
    out.append(f"{name}_a as (select r.read_id, {columns} from {source} r {joins})")
    m, n = "m1 is not null and m2 is not null", "n1 is not null and n2 is not null"
    if not random:
        kind = f"case when {m} then 'm' when m1 is not null then 'barcode1_only' when m2 is not null then 'barcode2_only' end"
    else:
        head = f"when {m} then 'm'" if first else f"when {m} and {n} and m1m + m2m < n1m + n2m then 'm' when {m} and {n} and m1m + m2m > n1m + n2m then 'n' when {m} and {n} and m1 = n1 and m2 = n2 then 'm' when {m} and {n} then 'none' when {m} then 'm'"
        kind = f"case {head} when {n} then 'n' when m1 is not null or n1 is not null then 'barcode1_only' when m2 is not null or n2 is not null then 'barcode2_only' end"
    two = "case kind when 'm' then m1 when 'n' then n1 end as idx1, case kind when 'm' then m2 when 'n' then n2 end as idx2" if random else "case kind when 'm' then m1 end as idx1, case kind when 'm' then m2 end as idx2"
    out.append(f"{name} as (select read_id, kind, {two} from (select *, {kind} as kind from {name}_a))")
    return out


def query(ctes: list[str], select: str) -> str:
    return f"with {BASE}, {TUPLES}, {', '.join(ctes)} {select}" if ctes else f"with {BASE}, {TUPLES} {select}"


def dense(matches: str, size: int) -> str:
    return f"select cast(i as integer) as idx, cast(count(m.read_id) as bigint) as count from range({size}) t(i) left join {matches} m on m.idx = t.i group by i"
