"""Reproducible shuffling and sharding by a keyed permutation of global row numbers.

Rows are numbered 0 .. n-1 in the order of their identifier.  A Feistel network over the
product of two residue rings of sizes ``a`` and ``b`` with a*b >= n permutes the numbers;
results that fall outside 0 .. n-1 are fed through it again (cycle walking) until they fall
inside.  A row's place p in the shuffle gives shard p mod m and slot p div m, so shards differ
by one row at most and slots have no gaps, and the place of any row number, or the row number
of any place, can be computed without the data.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.shared import Scratch, parallelism

ROUNDS = 6
_P = (1 << 31) - 1
_A, _B = 48271, 69621  # multipliers modulo the prime above
_STEP = 1_000_003


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of 0 .. n-1 and its inverse, over DataFrame columns."""

    n: int
    key: int = 20_240_601
    rounds: int = ROUNDS

    @property
    def sides(self) -> tuple[int, int]:
        a = max(1, math.isqrt(max(0, self.n - 1)) + 1)
        return a, max(1, -(-self.n // a))

    @property
    def walk(self) -> int:
        """Steps that always suffice: no walk visits an outside place twice, and beyond 64 of
        them (n over 4096, under one place in 64 outside) a longer walk has odds below 2**-384."""
        a, b = self.sides
        return min(64, a * b - self.n)

    def _half(self, half: Column, i: Column, size: int) -> Column:
        """The keyed round function; every product stays below 2**63 for halves below 2**31."""
        p = F.lit(_P)
        x = (half + (F.lit(self.key) + i * F.lit(_STEP)) % p) % p * F.lit(_A) % p
        y = (x + F.shiftright(x, 13)) % p * F.lit(_B) % p
        return (y + F.shiftright(y, 11)) % F.lit(size)

    def _step(self, x: Column, i: Column, sign: int) -> Column:
        """One round over l * b + r: the half that the round's number names moves by a function of the other."""
        a, b = self.sides
        left, right = (x - x % F.lit(b)) / F.lit(b), x % F.lit(b)
        left = F.floor(left).cast("long")
        moved_l = F.pmod(left + F.lit(sign) * self._half(right, i, a), F.lit(a)) * F.lit(b) + right
        moved_r = left * F.lit(b) + F.pmod(right + F.lit(sign) * self._half(left, i, b), F.lit(b))
        return F.when(i % 2 == 0, moved_l).otherwise(moved_r)

    def _apply(self, df: DataFrame, source: str, target: str, sign: int) -> DataFrame:
        rounds = [F.lit(i).cast("long") for i in (range(self.rounds) if sign > 0 else reversed(range(self.rounds)))]
        df = df.withColumn(target, F.aggregate(F.array(*rounds), F.col(source).cast("long"), lambda x, i: self._step(x, i, sign)))
        if not self.walk:
            return df
        # places outside go on, whole networks at a time; a place that has come inside is held as -1 - place
        again = F.flatten(F.array_repeat(F.array(*rounds), self.walk))
        last = rounds[-1]

        def on(x: Column, i: Column) -> Column:
            moved = self._step(x, i, sign)
            return F.when(x < 0, x).otherwise(F.when((i == last) & (moved < self.n), -1 - moved).otherwise(moved))

        out = F.col(target) >= self.n
        walked = F.aggregate(F.when(out, again).otherwise(F.array().cast("array<bigint>")), F.col(target), on)
        df = df.withColumn(target, F.when(out, -1 - walked).otherwise(F.col(target)))
        return df.withColumn(target, F.when(F.col(target) >= 0, F.col(target)).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long")))

    def place(self, df: DataFrame, row_number: str, place: str) -> DataFrame:
        """Adds the place in the shuffle of each row number."""
        return self._apply(df, row_number, place, 1)

    def row_number(self, df: DataFrame, place: str, row_number: str) -> DataFrame:
        """Adds the row number at each place of the shuffle."""
        return self._apply(df, place, row_number, -1)


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with row_number 0 .. n-1 in the given order (nulls first), and n.

    The rows are sorted into range partitions and written once, each with its partition and
    its position there; the partitions' counts, a row each, give the offsets.  Rows equal in
    all of ``order`` may swap places between runs, which no result can tell apart.
    """
    spark = df.sparkSession
    scratch, parts = Scratch(spark, "numbered"), parallelism(spark)
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = scratch.table(placed, "rows").withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at") - F.shiftleft("part", 33))
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each range partition, of which there are no more than shuffle partitions
    offsets = sizes.select("part", before.alias("before"))
    n = int(sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    return placed.join(F.broadcast(offsets), "part").withColumn("row_number", F.col("before") + F.col("at")).drop("part", "at", "before"), n


def shard(df: DataFrame, shards: int = 16, key: int = 20_240_601, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number, place.

    size is the UTF-8 length of the text plus 1 and text_crc32 its CRC-32; null text has no
    bytes (size 1, CRC 0).  The law is ``rows``: shard counts differ by one at most, slots are
    gapless from 0.  grown_shard is null, as the places depend on the number of rows.  Row
    numbers follow (doc_id, size, crc), null identifiers first; repeated rows each get a
    place.  Texts of any length count whole.  An empty table gives an empty result; other columns of df are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    rows, n = numbered(rows, ["doc_id", "size", "text_crc32"])
    placed = Permutation(n, key).place(rows, "row_number", "place")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
        "place",
    )


def sql(shards: int, key: int = 20_240_601) -> str:
    """``shard`` of the table documents as DuckDB SQL, with CRC-32 spelled out over bytes."""

    def half(x: str, i: str, size: str) -> str:
        first = f"(({x} + ({key} + {i} * {_STEP}) % {_P}) % {_P} * {_A} % {_P})"
        second = f"(({first} + ({first} >> 13)) % {_P} * {_B} % {_P})"
        return f"(({second} + ({second} >> 11)) % {size})"

    return f"""
with recursive t as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) crc
  from range(256) r(i)),
h as (select doc_id, coalesce(text, '') tx, hex(coalesce(text, '')) hx from documents),
d as (select doc_id, strlen(tx) + 1 as size,
  xor(4294967295::bigint, list_reduce(list_transform(range(1, length(hx), 2), lambda i: ('0x' || substr(hx, i, 2))::bigint),
    lambda c, b: xor(c >> 8, t.crc[1 + (xor(c, b) & 255)]::bigint), 4294967295::bigint)) as text_crc32
  from h, t),
s as (select *, row_number() over (order by doc_id nulls first, size, text_crc32) - 1 as row_number, count(*) over () n from d),
ab as (select n, ceil(sqrt(n))::bigint a, ceil(n / ceil(sqrt(n)))::bigint b from (select count(*) n from d)),
walk as (select row_number r, row_number x, 0::bigint i from s
  union all
  select r, case when i % 2 = 0 then ((x // b + {half("(x % b)", "i", "a")}) % a) * b + x % b
    else (x // b) * b + (x % b + {half("(x // b)", "i", "b")}) % b end, (i + 1) % {ROUNDS} + case when i + 1 = {ROUNDS} then {ROUNDS * 2} else 0 end
  from (select r, x, case when i >= {ROUNDS * 2} then 0 else i end i, a, b from walk, ab where i < {ROUNDS * 2} or x >= n)),
p as (select r, x from walk, ab where i >= {ROUNDS * 2} and x < n)
select doc_id, size, text_crc32, 'rows' as law, (x % {shards})::int as shard, x // {shards} as slot, null::int as grown_shard, row_number, x as place
from s join p on s.row_number = p.r
"""
