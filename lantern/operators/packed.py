"""Several values packed in one field (problem 2).

Method: dialects by minimum description length. Every reading of a field (JSON list, bracketed
list, delimited list under each quote alphabet, all of them also after restoring entities) is a
candidate. The length of a candidate is the code of its values: a value in the codebook of the
corpus costs its code, any other one is spelled, and a delimiter, mark or entity left over inside
an unprotected value costs far more than a letter because values hardly ever hold one. The codebook
is counted over all fields; each field is then read with its cheapest dialect. A reading that would
lose even if every value of it were free and every value of another were spelled is dropped before,
so only fields that are open after that are scored against the codebook.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Entries of the codebook that are broadcast, most frequent values first; those beyond it are
#: looked up by a shuffle join, so the length of a reading does not depend on the bound.
CODEBOOK = 65536
#: Bits of an ordinary character, of the end of a value, and of a structural character in a value.
CHAR_BITS, END_BITS, STRAY_BITS = 5.0, 4.0, 40.0

DELIMITERS = r";,|\t"
_BARE = rf"(?:\\.|[^{DELIMITERS}\\]++)+"
_ENTITY = r"(?i)&(lt|gt|amp|quot|apos|nbsp|#\d+|#x[0-9a-f]+);"
_EDGE_QUOTE = rf"(^|[\s{DELIMITERS}])[\"']"


def _quoted(marks: str) -> str:
    """Pattern of one piece of a delimited field in which values may be enclosed in the given marks."""
    alts = [rf"[^\S\t]*{m}(?:[^{m}\\]++|{m}{m}|\\.)*{m}[^\S\t]*(?=[{DELIMITERS}]|$)" for m in marks]
    return "|".join([*alts, _BARE])


def restore_entities(c: Column) -> Column:
    """Character entities as the characters they stand for; the ampersand last, so nothing is restored twice."""
    for name, char in (("lt|#60|#x3c", "<"), ("gt|#62|#x3e", ">"), ("quot|#34|#x22", '"'), ("apos|#39|#x27", "'"), ("nbsp|#160|#xa0", " "), ("amp|#38|#x26", "&")):
        c = F.regexp_replace(c, rf"(?i)&({name});", char)
    return c


def _tidy(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))


def _full(values: Column) -> Column:
    return F.filter(values, lambda x: x != "")


def _unquote(x: Column, marks: str) -> Column:
    x = F.regexp_replace(x, r"^\s+|\s+$", "")
    out = F.regexp_replace(x, r"\\(.)", "$1")
    for m in marks:
        inner = F.regexp_replace(F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), m + m, m), r"\\(.)", "$1")
        out = F.when((F.length(x) >= 2) & x.startswith(m) & x.endswith(m), inner).otherwise(out)
    return out


def _json(t: Column) -> Column:
    loose = F.transform(F.regexp_extract_all(t, F.lit(r'"((?:[^"\\]++|\\.)*)"'), F.lit(1)), lambda x: F.regexp_replace(x, r"\\(.)", "$1"))
    return _full(F.transform(F.coalesce(F.from_json(t, "array<string>"), loose), _tidy))


def _angle(t: Column) -> Column:
    pieces = F.regexp_extract_all(t, F.lit(rf"<[^<>]*>|[^<>{DELIMITERS}]+"), F.lit(0))
    return _full(F.transform(pieces, lambda x: _tidy(F.regexp_replace(F.when(x.startswith("<"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x), r"\\(.)", "$1"))))


def _delimited(t: Column, marks: str) -> Column:
    return _full(F.transform(F.regexp_extract_all(t, F.lit(_quoted(marks)), F.lit(0)), lambda x: _tidy(_unquote(x, marks))))


def _blank(t: Column) -> Column:
    return _full(F.transform(F.split(t, r"[\s\u00a0]+"), _tidy))


def _spelled(values: Column) -> Column:
    """Bits of all values spelled."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.length(x) * CHAR_BITS + END_BITS)


def _strays(reading: Column) -> Column:
    return reading["stray"] * STRAY_BITS


def candidate_readings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, readings): the readings of each field that is neither null nor blank, equal ones once, hopeless ones not at all.

    A reading is (stray, dialect, values). A dialect is admissible where the field has its marks at
    all; blanks separate values only where nothing else does. stray counts the structural characters
    that the dialect leaves in values without having protected them. A reading is hopeless when its
    strays alone cost more than another reading with all its values spelled. The columns are built
    in steps so that each pattern runs once per field.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("t0")).where(F.col("t0").isNotNull() & F.rlike(F.col("t0"), F.lit(r"[^\s\u00a0]")))
    # Everything later is grouped by key and finds its rows in place; the number is fixed so that
    # a small table of costly fields is not coalesced into one task.
    rows = rows.repartition(parts, "key")
    rows = rows.withColumn("t1", F.when(F.rlike("t0", F.lit(_ENTITY)), restore_entities(F.col("t0"))))
    marked = F.rlike(F.col("t0"), F.lit(rf"[{DELIMITERS}<>\[\]]|{_EDGE_QUOTE}")) | F.col("t1").isNotNull()
    rows = rows.withColumn("marked", marked)
    values, kinds = {"blank": F.when(~F.col("marked"), _blank(F.col("t0")))}, [("blank", "t0", None)]
    for t in ("t0", "t1"):
        c = F.col(t)
        values[f"json_{t}"] = F.when(F.rlike(c, F.lit(r"^\s*\[.*\]\s*$")), _json(c))
        values[f"angle_{t}"] = F.when(F.rlike(c, F.lit(r"<[^<>]*>")), _angle(c))
        kinds += [(f"json_{t}", t, r'"(?:[^"\\]++|\\.)*"|[\s,\[\]]'), (f"angle_{t}", t, rf"<[^<>]*>|[^<>\[\]]")]
        for name, marks in (("bare", ""), ("double", '"'), ("single", "'"), ("both", "\"'")):
            has = F.lit(True) if not marks else F.rlike(c, F.lit(rf"(^|[\s{DELIMITERS}])[{marks}]"))
            values[f"{name}_{t}"] = F.when(F.col("marked") & has, _delimited(c, marks))
            kinds.append((f"{name}_{t}", t, None))
    rows = rows.withColumns(values)
    options = []
    for n, (name, t, protected) in enumerate(kinds):
        v = F.col(name)
        if name == "blank":
            stray = F.lit(0)
        elif protected and name.startswith("json"):
            stray = F.length(F.regexp_replace(t, protected, ""))
        elif protected:
            stray = F.length(F.regexp_replace(t, protected, "")) + F.size(F.filter(v, lambda x: F.rlike(x, F.lit("^[\"'].*[\"']$"))))
        else:
            stray = F.aggregate(v, F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit(r"[<>]|^[\[\"']|[\]\"']$")))
        stray = stray + F.coalesce(F.regexp_count(t, F.lit(_ENTITY)), F.lit(0))
        options.append(F.when(v.isNotNull(), F.struct(stray.cast("int").alias("stray"), F.lit(n).alias("dialect"), v.alias("values"))))
    rows = rows.select("key", F.filter(F.array(*options), lambda x: x.isNotNull()).alias("found"))
    # Of readings with the same values the one that leaves the fewest strays stands for all.
    same = F.aggregate(
        F.array_sort("found"),
        F.slice("found", 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda y: y["values"] == x["values"]), acc).otherwise(F.concat(acc, F.array(x))),
    )
    rows = rows.select("key", same.alias("readings"))
    most = F.array_min(F.transform("readings", lambda r: _strays(r) + _spelled(r["values"])))
    return rows.withColumn("most", most).select("key", F.filter("readings", lambda r: _strays(r) <= F.col("most")).alias("readings"))


def codebook(candidates: DataFrame) -> DataFrame:
    """(value, bits): the code lengths of all values that the readings confirm.

    A field counts its readings in equal parts, so values that only a wrong reading produces stay
    rare while those confirmed by plain fields gain.
    """
    # The readings without strays explain a field best; they alone vote, in equal parts. None of
    # them is ever hopeless.
    clean = F.filter("readings", lambda r: r["stray"] == F.array_min(F.transform("readings", lambda x: x["stray"])))
    votes = (
        candidates.select(F.explode(clean).alias("r"), F.size(clean).alias("k"))
        .select(F.explode("r.values").alias("value"), (F.lit(1.0) / F.col("k")).alias("w"))
        .groupBy("value")
        .agg(F.sum("w").alias("w"))
    )
    total = votes.agg(F.sum("w").alias("total"))
    return votes.where("w >= 2").join(F.broadcast(total)).select("value", (-F.log2(F.col("w") / F.col("total"))).alias("bits"))


def _coded(values: DataFrame, book: DataFrame, size: int) -> DataFrame:
    """values with the bits of their value, null outside the codebook."""
    if book.count() <= size:
        return values.join(F.broadcast(book), "value", "left")
    # Frequent values stay where they are; only the others, none of them hot, are shuffled.
    top = F.broadcast(book.orderBy("bits", "value").limit(size))
    rest = values.join(top, "value", "left_anti").join(book, "value", "left")
    return values.join(top, "value").unionByName(rest)


def split_packed(df: DataFrame, key: str, text: str, size: int = CODEBOOK) -> DataFrame:
    """(key, pos, value): one row per value of each field, pos counting from 1.

    key must be unique in df. Null, empty and blank fields give no rows; empty values are skipped
    and take no position; repeated values keep all their positions; values are lower-cased. Only
    the two named columns are read. A field of any length is parsed whole, in one pass per dialect,
    and once: the readings are written down for the count of the codebook and the choice.
    """
    rows = cut(candidate_readings(df, key, text))
    book = cut(codebook(rows))
    open_ = rows.where(F.size("readings") > 1)
    values = _coded(open_.select("key", F.explode(F.array_distinct(F.flatten("readings.values"))).alias("value")), book, size)
    known = values.where("bits is not null").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("value", "bits"))).alias("known"))
    cost = lambda r: F.round(
        F.aggregate(r["values"], _strays(r), lambda a, x: a + F.least(F.coalesce(F.element_at("known", x), F.length(x) * CHAR_BITS + END_BITS), F.length(x) * CHAR_BITS + END_BITS)), 6
    )
    ranked = F.array_min(F.transform("readings", lambda r: F.struct(cost(r).alias("cost"), r["dialect"].alias("dialect"), r["values"].alias("values"))))
    chosen = open_.join(known, "key", "left").select("key", ranked["values"].alias("values"))
    best = rows.where(F.size("readings") == 1).select("key", F.col("readings")[0]["values"].alias("values")).unionByName(chosen)
    return best.select(F.col("key").alias(key), F.posexplode("values").alias("p", "value")).select(key, (F.col("p") + 1).cast("int").alias("pos"), "value")
