"""Licence scans of whole texts with DataFrame functions only.

A paragraph is a line, or what of a wrapped one stands in adjacent lines. Its
word n-grams that the trained model knows add up to one score a family; the
softmax of the scores gives a family or, below the calibrated threshold, none.
A prediction is confirmed when enough of the n-grams of one of the family's
notices stand in the paragraph, with the family's name if the notice holds it
and without the name of a licence of like wording. Lines are judged alone and, for notices that
are wrapped, together with the lines that follow without a blank one between.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .license_model import CONFIRM, NOTICES, OTHERS, SCALE, Model, features, names as names_in, trained, words

SPLIT = r"[^a-z0-9]+"
#: Lines without a word end a paragraph.
BREAK = r"\n[^A-Za-z0-9]*\n"
#: Words of adjacent lines that are judged together: a notice and what else stands in the line it starts in.
WINDOW = 2 * max(len(words(t)) for texts in NOTICES.values() for t in texts)


def _words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), SPLIT), lambda w: w != "")


def _features(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, pairs))


def _strings(values) -> Column:
    return F.split(F.lit("\n".join(values)), "\n")


def _constant(value, kind: str) -> Column:
    """A nested value as one literal, which plans take in at once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(docs: DataFrame, model: Model | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_paragraphs, n_predicted, n_confirmed, families, top_family, top_probability) of every row, without a shuffle.

    ``n_paragraphs`` counts lines with a visible character, ``families`` joins
    the confirmed ones in order by a comma; the top one has the highest
    probability of the confirmed (then the first line's). Without any they are
    '', '' and 0. A family that adjacent lines confirm together but none of
    them alone counts once a paragraph, in place of such lines' predictions of
    it. A null text is an empty one; null keys and repeated rows give a row
    each; other columns are left aside; an empty table gives no row.
    """
    model = model or trained()
    weights = _constant(model.weights, "map<string,array<bigint>>")
    known = _strings(model.weights)
    marks, of_notices = model.marks, sorted({w for texts in NOTICES.values() for t in texts for w in words(t)})
    bias = F.split(F.lit(",".join(map(str, model.bias))), ",").cast("array<bigint>")
    names = _strings(model.families)
    notices = _constant({n: [{"features": sorted(features(t)), "names": names_in(n, t)} for t in texts] for n, texts in NOTICES.items()}, "map<string,array<struct<features:array<string>,names:array<string>>>>")
    others = _constant({n: OTHERS.get(n, ()) for n in NOTICES}, "map<string,array<string>>")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("t"))
    lines = F.split("t", "\n")
    rows = rows.withColumn("n_paragraphs", F.size(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long"))
    parts = F.flatten(F.transform(F.split("t", BREAK), lambda b, i: F.transform(F.split(b, "\n"), lambda x: F.struct(i.alias("block"), _words(x).alias("words")))))
    rows = rows.select("doc_id", "n_paragraphs", F.filter(parts, lambda x: F.size(x["words"]) > 0).alias("parts"))

    def together(part: Column, i: Column) -> Column:
        near = F.filter(F.slice("parts", i + 1, WINDOW), lambda x: x["block"] == part["block"])
        several = (F.size(near) > 1) & (F.size(part["words"]) < WINDOW)
        joined = F.slice(F.flatten(F.transform(near, lambda x: F.slice(x["words"], 1, WINDOW))), 1, WINDOW)
        return F.struct(part["block"].alias("block"), i.alias("at"), F.when(several, joined).otherwise(F.array().cast("array<string>")).alias("words"))

    def told(spans: Column) -> Column:
        # a line without any feature of the model has the scores of its bias, which ``Model`` holds to be the unknown class
        spans = F.filter(spans, lambda x: F.exists(x["words"], lambda w: w.isin(marks)))
        return F.filter(F.transform(spans, lambda x: F.struct(x["block"].alias("block"), x["at"].alias("at"), _features(x["words"]).alias("found"))), lambda x: F.arrays_overlap(x["found"], known))

    # what a text as a whole doesn't hold enough of, none of its windows does
    # words of no notice are left out first, which can only add pairs
    told_words = F.flatten(F.transform("parts", lambda x: F.filter(x["words"], lambda w: w.isin(of_notices))))
    held = F.array_intersect(_features(told_words), _strings(sorted({f for texts in NOTICES.values() for t in texts for f in features(t)})))
    # bound as an element, since the optimizer would move a column's expression into the inner function
    enough = F.exists(F.array(held), lambda h: F.exists(F.flatten(F.map_values(notices)), lambda n: F.size(F.array_intersect(n["features"], h)) >= F.lit(CONFIRM) * F.size(n["features"])))
    rows = rows.withColumn("windows", F.when((F.size("parts") > 1) & enough, F.transform("parts", together)))
    alone = F.transform("parts", lambda x, i: F.struct(x["block"].alias("block"), i.alias("at"), x["words"].alias("words")))
    rows = rows.select("doc_id", "n_paragraphs", told(alone).alias("lines"), F.coalesce(told(F.col("windows")), F.array().cast("array<struct<block:int,at:int,found:array<string>>>")).alias("wide"))

    def scores(found: Column) -> Column:
        return F.aggregate(F.array_intersect(found, known), bias, lambda total, f: F.zip_with(total, F.element_at(weights, f), lambda a, b: a + b))

    def judged(line: Column) -> Column:
        s = line["scores"]
        top = F.array_max(s)
        best = F.array_position(s, top)
        return F.struct(
            line["block"].alias("block"),
            line["at"].alias("at"),
            F.element_at(names, best.cast("int")).alias("family"),
            (F.lit(1.0) / F.aggregate(s, F.lit(0.0), lambda total, x: total + F.exp((x - top) / F.lit(float(SCALE))))).alias("probability"),
            line["found"].alias("found"),
        )

    def confirmed(line: Column) -> Column:
        def by(n: Column) -> Column:
            enough = F.size(F.array_intersect(n["features"], line["found"])) >= F.lit(CONFIRM) * F.size(n["features"])
            return enough & ((F.size(n["names"]) == 0) | F.arrays_overlap(n["names"], line["found"]))

        return F.exists(F.element_at(notices, line["family"]), by) & ~F.arrays_overlap(F.element_at(others, line["family"]), line["found"])

    for c in ("lines", "wide"):
        rows = rows.withColumn(c, F.transform(c, lambda x: F.struct(x["block"].alias("block"), x["at"].alias("at"), x["found"].alias("found"), scores(x["found"]).alias("scores"))))
        rows = rows.withColumn(c, F.filter(F.transform(c, judged), lambda x: (x["family"] != model.families[0]) & (x["probability"] >= model.threshold)))

    def among(name: str, x: Column) -> Column:
        return F.exists(name, lambda y: (y["block"] == x["block"]) & (y["family"] == x["family"]))

    rows = rows.withColumn("sure", F.filter("lines", confirmed))
    rows = rows.withColumn("wide", F.filter("wide", lambda x: ~among("sure", x) & confirmed(x)))
    rows = rows.withColumn("wrapped", F.array_distinct(F.transform("wide", lambda x: F.struct(x["block"].alias("block"), x["family"].alias("family")))))
    rows = rows.withColumn("lines", F.filter("lines", lambda x: ~among("wrapped", x)))
    rows = rows.withColumn("all", F.transform(F.concat("sure", "wide"), lambda x: F.struct(x["probability"].alias("p"), (-x["at"]).alias("i"), x["family"].alias("family"))))
    ranked = F.array_max("all")
    return rows.select(
        "doc_id", "n_paragraphs", (F.size("lines") + F.size("wrapped")).cast("long").alias("n_predicted"), (F.size("sure") + F.size("wrapped")).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("all", lambda x: x["family"]))), ",").alias("families"),
        F.coalesce(ranked["family"], F.lit("")).alias("top_family"), F.round(F.coalesce(ranked["p"], F.lit(0.0)), 4).alias("top_probability"),
    )
