"""Removal of repeated passages of three lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` less its repeated windows, and the columns n_lines and n_removed (long).

    Lines end at a line feed. Every three consecutive lines form a window; windows overlap. Of equal windows anywhere the
    one with the smallest (id, place) stays, and each line that a later one covers goes. Windows are
    judged on the input. Texts under three lines have no window and stay. Null text stays null (no lines); a text of
    which all goes becomes empty. Rows that repeat id and text count as one document, so neither
    removes the other; null ids are ids of their own and come first. Other columns pass through; those named
    n_lines or n_removed are replaced.
    """
    # Every column of docs goes along inside of one, so none can clash with those made here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    of = lambda c: F.col("row").getField(c)
    lines = F.split(of(text_col), "\n")
    key = [of(id_col).alias("id"), F.xxhash64(of(text_col)).alias("text_hash")]

    def window(i: Column) -> Column:
        three = [F.get(F.col("lines"), i + k) for k in range(3)]
        return F.struct(F.xxhash64(*three).alias("a"), F.hash(*three).alias("b"))

    found = rows.select(*key, lines.alias("lines")).where(F.size("lines") >= 3)
    found = found.select("id", "text_hash", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("lines") - 3), window)).alias("at", "w"))
    found = found.select("id", "text_hash", "at", F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    place = F.struct("id", "text_hash", "at")
    firsts = found.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    later = found.join(firsts.select("a", "b", "first"), ["a", "b"]).where(~F.col("first").eqNullSafe(place))
    covered = later.groupBy(F.col("id").alias("covered_id"), F.col("text_hash").alias("covered_text")).agg(F.array_sort(F.collect_set("at")).alias("covered"))

    # What stays lies between the covered windows: from the end of one to the start of the next.
    starts = F.concat(F.array(F.lit(0)), F.transform("covered", lambda p: p + 3))
    ends = F.concat(F.col("covered"), F.array(F.size("lines")))
    gaps = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda g: g["e"] > g["s"])
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(F.col("lines"), g["s"] + 1, g["e"] - g["s"])))
    n_lines = F.when(F.col("lines").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long")
    out = rows.withColumn("hash", F.xxhash64(of(text_col))).join(covered, of(id_col).eqNullSafe(F.col("covered_id")) & (F.col("hash") == F.col("covered_text")), "left")
    out = out.withColumn("lines", lines).withColumn("kept", F.when(F.col("covered").isNotNull(), kept))
    removed = F.when(F.col("covered").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("kept")).cast("long")
    text = F.when(F.col("covered").isNull(), of(text_col)).otherwise(F.array_join("kept", "\n"))
    made = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*[(text if c == text_col else of(c)).alias(c) for c in made], n_lines.alias("n_lines"), removed.alias("n_removed"))


ORACLE_SQL = """
with d as (select distinct doc_id, text from documents),
l as (select row_number() over (order by doc_id nulls first, text) as doc, doc_id, text, string_split(text, chr(10)) as ls from d),
w as (select doc, p as pos, ls[p] || chr(10) || ls[p + 1] || chr(10) || ls[p + 2] as win
      from (select doc, ls, unnest(range(1, len(ls) - 1)) as p from l where len(ls) >= 3)),
r as (select doc, pos, row_number() over (partition by win order by doc, pos) as k from w),
c as (select distinct doc, pos + i as pos from r, (select unnest([0, 1, 2]) as i) where k > 1),
e as (select doc, unnest(range(1, len(ls) + 1)) as pos, unnest(ls) as line from l),
k as (select e.doc, string_agg(e.line, chr(10) order by e.pos) as kept, count(*) as n
      from e left join c on e.doc = c.doc and e.pos = c.pos where c.pos is null group by e.doc)
select o.doc_id, coalesce(len(l.ls), 0)::bigint as n_lines, (coalesce(len(l.ls), 0) - coalesce(k.n, 0))::bigint as n_removed,
       case when l.text is null then null else coalesce(k.kept, '') end as text
from documents o join l on o.doc_id is not distinct from l.doc_id and o.text is not distinct from l.text left join k on l.doc = k.doc
"""
