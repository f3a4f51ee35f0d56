"""License scans in DataFrame operations only: ordered signature rules behind a keyword filter.

A text is brought to words with one space around each. A rule's expression runs on all texts that hold the rule's keyword, as each of
its matches does; one expression finds the keywords. A detection inside another of the same or a higher priority is dropped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table
from .license_rules import all_rules

#: Phrases of the base, by label. Fixed values.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DETECTION = "struct<priority int, n int, label string, start int, stop int, weight double>"


def rules() -> list[dict]:
    return all_rules(BASE)


def grouped() -> list[dict]:
    """The rules by keyword, without the space before it."""
    out: dict[str, list[dict]] = {}
    for r in rules():
        out.setdefault(r["keyword"].removeprefix(" "), []).append({k: v for k, v in r.items() if k != "keyword"})
    return [{"keyword": k, "rules": v} for k, v in out.items()]


def longest(words: Iterable[str]) -> str:
    """An expression, branching letter by letter, of the longest of the words that stand at a place."""
    tails: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        tails.setdefault(w[:1], []).append(w[1:])
    ends = tails.pop("", None)
    if not tails:
        return ""
    branches = "|".join(re.escape(c) + longest(t) for c, t in tails.items())
    return f"(?:{branches})?" if ends else f"(?:{branches})" if len(tails) > 1 else branches


def words_spaced(text: Column) -> Column:
    """Lower-cased words with one space before and after each; one space if there are none."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(" ")), NOT_WORD, " ")))


#: All places of a rule's expression: the text between matches and the matches' own lengths add up to them.
PLACES = """
aggregate(zip_with(slice(split(spaced, r.regex, -1), 1, size(regexp_extract_all(spaced, r.regex, 0))), regexp_extract_all(spaced, r.regex, 0), (g, h) -> named_struct('gap', g, 'hit', h)),
    named_struct('at', 0, 'found', cast(array() AS array<{d}>)),
    (acc, x) -> named_struct('at', acc.at + length(x.gap) + length(x.hit), 'found', array_append(acc.found,
        named_struct('priority', r.priority, 'n', r.n, 'label', r.label, 'start', acc.at + length(x.gap), 'stop', acc.at + length(x.gap) + length(x.hit), 'weight', r.weight))),
    acc -> acc.found)""".format(d=DETECTION)

#: Inside another of no lower priority; of two on the same place the rule that comes first stays.
FREE = """
filter(detections, d -> NOT exists(detections, o -> o.start <= d.start AND o.stop >= d.stop AND o.priority <= d.priority
    AND (o.stop - o.start > d.stop - d.start OR o.priority < d.priority OR o.n < d.n)))"""


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with n_words, base (array of the base phrases' places: word, label) and detections (those that stay) added.

    Places in detections are characters of the spaced text. Null and empty texts: no words, nothing found. Every row stays.
    The documents' own columns of the three names are replaced; all others are kept, whatever they are called.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "base", "detections")]
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("doc"), words_spaced(F.col(f"`{text_col}`")).alias("spaced"))
    out = out.withColumn("n_words", (F.length("spaced") - F.length(F.replace("spaced", F.lit(" "), F.lit(""))) - 1).cast("long"))
    schema = "array<struct<keyword string, rules array<struct<priority int, label string, regex string, weight double, n int>>>>"
    out = out.withColumn("groups", F.from_json(F.lit(json.dumps(grouped())), schema))
    # At each word the longest keyword is found, of which all others there are beginnings.
    out = out.withColumn("held", F.array_distinct(F.regexp_extract_all("spaced", F.lit(f" (?=({longest(g['keyword'] for g in grouped())}))"), F.lit(1))))
    out = out.withColumn("groups", F.expr("IF(size(held) > 0, filter(groups, g -> exists(held, h -> startswith(h, g.keyword))), slice(groups, 1, 0))"))
    parts = []
    for label, phrase in BASE:
        first, n = phrase.split()[0], len(phrase.split())
        same = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
        parts.append(f"transform(filter(IF(contains(spaced, ' {phrase} '), sequence(0, greatest(0, size(words) - {n})), array()), i -> size(words) >= {n} AND words[i] = '{first}' AND {same}), i -> named_struct('word', cast(i AS bigint), 'label', '{label}'))")
    some = " OR ".join(f"contains(spaced, ' {phrase} ')" for _, phrase in BASE)
    out = out.withColumn("words", F.when(F.expr(some), F.split(F.trim("spaced"), " ")).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("base", F.expr(f"IF(size(words) > 0, concat({', '.join(parts)}), cast(array() AS array<struct<word bigint, label string>>))"))
    out = out.withColumn("detections", F.expr(f"IF(size(groups) > 0, flatten(transform(groups, g -> flatten(transform(filter(g.rules, r -> rlike(spaced, r.regex)), r -> {PLACES})))), cast(array() AS array<{DETECTION}>))"))
    return out.withColumn("detections", F.expr(FREE)).select(*(F.col(f"doc.`{c}`").alias(c) for c in kept), "n_words", "base", "detections")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base, own = F.expr("transform(base, b -> b.label)"), F.expr("transform(detections, d -> d.label)")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.expr("array_min(transform(base, b -> b.word))").alias("first_word"), F.expr("array_max(transform(base, b -> b.word))").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.expr("IF(size(base) > 0, greatest(0.95D, coalesce(array_max(transform(detections, d -> d.weight)), 0D)), coalesce(array_max(transform(detections, d -> d.weight)), 0D))").alias("score"),
    )
