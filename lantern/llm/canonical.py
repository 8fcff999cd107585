"""Mapping free-entered values to a canonical list (problem 3).

Method: symmetric-delete lookup. Every name of the list is filed under itself with up to two letters
deleted; a stretch of a text finds its candidates by deleting up to two of its own letters, so no
pair of text and name is compared without sharing a key. Candidates are ranked by a weighted
Damerau-Levenshtein distance, what the rest of the text says of region and country, and how often
the entry is meant elsewhere. Texts that name no entry are reported with 0.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .pii import fold, plain

#: Entries of the list in one dictionary; a longer list is searched in so many blocks more.
BLOCK = 100_000
#: Stretches of fewer letters are no misspelling of anything.
SHORT = 4
#: Answers remembered by each worker.
MEMORY = 1 << 16
_MAIL = re.compile(r"\S+\s?(?:@|\(at\)|\[at\]|\sAT\s)\s?\S+(?:\s?(?:\[dot\]|\(dot\)|\sDOT\s)\s?\S+)*")
_TOKEN = re.compile(r"[^\W_]+")
_VOWELS = set("aeiouy")


def allowed(n: int) -> int:
    """Edits that a stretch of n letters may have."""
    return 2 if n >= 7 else 1 if n >= 5 else 0


def deletes(word: str, most: int) -> set[str]:
    """word with up to `most` letters deleted."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def distance(a: str, b: str, most: int) -> tuple[int, float]:
    """(edits, weight): unrestricted Damerau-Levenshtein distance, and its weighted form for ranking.

    A swap of neighbours weighs least, also with letters put in or left out between them, and a
    vowel for a vowel less than any other letter. Lengths too far apart only give more than `most`.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1, 9.0
    rows = [[(j, j * 0.9) for j in range(len(b) + 1)]]
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        row, last, above = [(i, i * 0.9)], 0, rows[-1]
        for j, y in enumerate(b, 1):
            swap_i, swap_j = seen.get(y, 0), last
            if x == y:
                step, last = (above[j - 1][0], above[j - 1][1]), j
            else:
                step = (above[j - 1][0] + 1, above[j - 1][1] + (0.8 if x in _VOWELS and y in _VOWELS else 1.0))
            best = min(step, (above[j][0] + 1, above[j][1] + 0.9), (row[-1][0] + 1, row[-1][1] + 0.9))
            if swap_i and swap_j:
                base, between = rows[swap_i - 1][swap_j - 1], (i - swap_i - 1) + (j - swap_j - 1)
                best = min(best, (base[0] + 1 + between, base[1] + 0.7 + between * 0.9))
            row.append(best)
        seen[x] = i
        rows.append(row)
    return rows[-1][-1]


@dataclass
class Dictionary:
    """A block of the list, filed for lookup."""

    #: entry id -> (folded region or '', folded country)
    entries: dict[int, tuple[str, str]] = field(default_factory=dict)
    names: dict[str, list[int]] = field(default_factory=dict)
    #: names of fewer than SHORT letters, found only as they are
    short: dict[str, list[int]] = field(default_factory=dict)
    filed: dict[str, list[str]] = field(default_factory=dict)
    countries: dict[str, str] = field(default_factory=dict)
    words: int = 1

    @classmethod
    def of(cls, rows: list[tuple], countries: list[tuple]) -> Dictionary:
        """rows: (id, name, region, country); countries: (country, code) of the whole list."""
        d = cls()
        for country, code in countries:
            d.countries[spaced(country)] = spaced(country)
            if code:
                d.countries[code.lower()] = spaced(country)
        for key, name, region, country in rows:
            d.entries[key] = (spaced(region), spaced(country))
            full = spaced(name)
            if not full:
                continue
            if len(full) < SHORT:
                d.short.setdefault(full, []).append(key)
            head, _, rest = full.partition(" ")
            forms = {full}
            if rest:
                # The first word of a name may be cut to one to three letters or its first and last.
                forms |= {f"{h} {rest}" for h in (head[:1], head[:2], head[:3], head[0] + head[-1])}
            for form in forms:
                d.names.setdefault(form, []).append(key)
                d.words = max(d.words, form.count(" ") + 1)
        for form in d.names:
            for key in deletes(form, allowed(len(form))):
                d.filed.setdefault(key, []).append(form)
        return d

    def lookup(self, stretch: str, where: set[str], exact: bool = False) -> list[tuple[str, float]]:
        """(name, weight) of every name within the edits allowed for the stretch.

        A name that is the stretch itself leaves no room for others if one of its entries is in a
        country of where. Whether that is so never depends on the other entries of the dictionary:
        what is left out here would lose against that entry anyway.
        """
        if len(stretch) < SHORT:
            return [(stretch, 0.0)] if stretch in self.short else []
        same = stretch in self.names
        if exact or (same and (not where or any(self.entries[k][1] in where for k in self.names[stretch]))):
            return [(stretch, 0.0)] if same else []
        most, seen, out = allowed(len(stretch)), set(), []
        if not most:
            return out
        for key in deletes(stretch, most):
            for name in self.filed.get(key, ()):
                if name not in seen:
                    seen.add(name)
                    edits, weight = distance(stretch, name, most)
                    if edits <= min(most, allowed(len(name))):
                        out.append((name, weight))
        return out


def spaced(text: str | None) -> str:
    """The words of a text, folded, with one blank between."""
    return " ".join(_TOKEN.findall(fold(text))) if text else ""


def best_match(d: Dictionary, text: str | None, freq: dict[int, int], exact: bool = False) -> tuple[float, int, int, int, int]:
    """(cost, -length, -frequency, id, ties) of the entry a text means, by which matches of several dictionaries are compared; id 0 where it means none.

    A country named in the text excludes entries of other countries. ties are the entries that fit
    as well but for their frequency, itself included. With exact, only unchanged names are looked for.
    """
    none = (9.0, 0, 0, 0, 0)
    flat = _MAIL.sub(" ", plain(text)[0])
    tokens = [fold(t) for t in _TOKEN.findall(flat)]
    if not tokens:
        return none
    where: set[str] = set()
    used: set[int] = set()
    for n in range(min(4, len(tokens)), 0, -1):
        for i in range(len(tokens) - n + 1):
            country = d.countries.get(" ".join(tokens[i : i + n]))
            # Two letters are a country code only beside a name, at either end.
            if country and (n > 1 or len(tokens[i]) > 3 or (len(tokens) > 1 and i in (0, len(tokens) - 1))):
                where.add(country)
                used.update(range(i, i + n))
    whole = " " + " ".join(tokens) + " "
    found: list[tuple[float, int, int, int]] = []
    for n in range(1, d.words + 1):
        for i in range(len(tokens) - n + 1):
            stretch = " ".join(tokens[i : i + n])
            if used.intersection(range(i, i + n)) or stretch.isdigit():
                continue
            for name, weight in d.lookup(stretch, where, exact):
                for key in (d.short if len(stretch) < SHORT else d.names)[name]:
                    region, country = d.entries[key]
                    if where and country not in where:
                        continue
                    hint = 0.6 * bool(where) + 0.3 * bool(region and f" {region} " in whole)
                    found.append((round(weight - hint, 6), -len(stretch), -freq.get(key, 0), key))
    if not found:
        return none
    found.sort()
    return *found[0], len({k for c, size, _, k in found if (c, size) == found[0][:2]})


def map_to_list(df: DataFrame, key: str, text: str, places: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, place_id): the entry of places meant by each text that is neither null nor blank, 0 for none.

    places has place_id, city, region, country and country_code; region and code may be null. It
    is the reference list, not data: it is collected and broadcast in blocks of at most about
    `block` entries, and the texts are read once per block and once more, exactly, to count how
    often each entry is meant. Row by row and without a shuffle as long as there is one block, so a
    text that a third of all rows have meets in no task; a frequent text is answered from a bounded
    memory. The best matches of several blocks are compared as those of one, so the answer does not
    depend on the blocks; key must be unique then. Rows without a key are left out and repeated
    rows answered each; only the named columns are read. An empty list leaves every text unmatched,
    an empty table gives no rows; entries without id or city are no entries. Names of fewer than
    four letters are found only as they are. Among entries that fit a text alike the more frequent
    one is meant, then the one with the smaller id.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    rows = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & F.rlike(F.col("text"), F.lit(r"[^\s\u00a0]"))), "key")
    kind = dict(df.dtypes)[key]
    blocks = max(1, -(-places.count() // block))
    # As many countries as the list has; a list of millions of places still has some hundreds.
    countries = [tuple(r) for r in places.select("country", "country_code").dropna(subset=["country"]).distinct().collect()]

    def pass_over(part: DataFrame, freq: dict[int, int], exact: bool) -> DataFrame:
        entries = [tuple(r) for r in part.select("place_id", "city", "region", "country").dropna(subset=["place_id", "city"]).orderBy("place_id").collect()]
        shared = sc.broadcast((Dictionary.of(entries, countries), freq))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            d, counted = shared.value
            known: OrderedDict[str, tuple] = OrderedDict()
            for b in batches:
                out = []
                for t in b["text"]:
                    hit = known.get(t)
                    if hit is None:
                        hit = known[t] = best_match(d, t, counted, exact)
                        if len(known) > MEMORY:
                            known.popitem(last=False)
                    else:
                        known.move_to_end(t)
                    out.append(hit)
                yield pd.DataFrame([(k, *o) for k, o in zip(b["key"], out)], columns=["key", "cost", "size", "freq", "place_id", "ties"]).astype({"key": b["key"].dtype})

        return rows.mapInPandas(run, f"key {kind}, cost double, size int, freq long, place_id int, ties int")

    parts = [places if blocks == 1 else places.where(F.pmod(F.xxhash64("place_id"), F.lit(blocks)) == n) for n in range(blocks)]

    def over_all(freq: dict[int, int], exact: bool) -> DataFrame:
        answers = pass_over(parts[0], freq, exact)
        if blocks == 1:
            return answers
        for part in parts[1:]:
            answers = answers.unionByName(pass_over(part, freq, exact))
        fit = answers.groupBy("key", "cost", "size").agg(F.min(F.struct("freq", "place_id")).alias("x"), F.sum("ties").cast("int").alias("ties"))
        best = fit.groupBy("key").agg(F.min(F.struct("cost", "size", "x", "ties")).alias("b"))
        return best.select("key", F.col("b.x.place_id").alias("place_id"), F.col("b.ties").alias("ties"))

    meant = over_all({}, True).where("ties = 1").groupBy("place_id").agg(F.count("*").alias("n")).collect()
    answers = over_all({r.place_id: r.n for r in meant}, False)
    return answers.select(F.col("key").alias(key), F.col("place_id").cast("int").alias("place_id"))
