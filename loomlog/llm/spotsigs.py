"""Document fingerprints by spot signatures, in DataFrame functions only.

Words are split into common words and content words. Each common word is an anchor: with
the chain of the next two content words it forms a signature. A document's fingerprint is
its set of signatures, sorted, eight hex digits each. Likeness is the Jaccard of two sets.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, cut, null_ids, table, with_ids

# Common words of four languages.
ANCHORS = {
    "en": "the of and a to in is was be it that for on with as are at by this from or an not have he his she they we you but which were had has their been".split(),
    "de": "der die das und zu ein eine einer mit sich auf ist im dem den des nicht von sie auch als an es für werden aus er hat dass wird bei einen um am sind noch wie".split(),
    "fr": "le la les et un une du en est que qui dans ce il au pas pour sur se plus par avec tout mais ou son elle lui nous vous sont cette aux leur ont".split(),
    "es": "el los las y una del al lo su por con para como más pero sus ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde".split(),
}
CHAIN = 2
#: Documents in a window of neighbours, and bins of the id's distribution.
WINDOW_DOCS, ID_BINS, MAX_WINDOWS = 2000, 200, 20_000
GLUE, END = "\x01", "\x02"


def _let(value: Column, body) -> Column:
    """body(x) with x bound to value, which is then computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signatures(text: Column) -> Column:
    """The distinct signatures (int) of a text, sorted.

    A text without a whole chain has one signature: of all its words; without words: none.
    Each content word is glued behind the common words before it, so that one pass over
    such runs finds every anchor's chain.
    """
    stop = sorted({w for ws in ANCHORS.values() for w in ws})
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    glued = F.transform(words, lambda w: F.concat(w, F.when(w.isin(stop), GLUE).otherwise(END)))

    def chains(runs: Column) -> Column:
        last = F.transform(runs, lambda r: F.substring_index(r, GLUE, -1))
        # chain of run i: its content word and that of the runs after it
        tails = F.zip_with(last, F.slice(last, 2, F.lit(1 << 30)), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.flatten(F.zip_with(runs, tails, lambda r, t: F.when(t.isNotNull(), F.transform(F.filter(F.split(r, GLUE), lambda w: w.isin(stop)), lambda w: F.hash(w, t))).otherwise(F.array().cast("array<int>"))))

    def whole(ws: Column) -> Column:
        runs = F.split(F.array_join(ws, ""), END)
        content = F.filter(runs, lambda r: (r != "") & ~r.endswith(GLUE))
        found = _let(content, chains)
        return _let(F.array_sort(F.array_distinct(found)), lambda s: F.when(F.size(s) > 0, s).when(F.size(ws) > 0, F.array(F.hash(F.array_join(ws, "")))).otherwise(F.array().cast("array<int>")))

    return _let(glued, whole)


def as_text(sigs: Column) -> Column:
    return F.lower(F.array_join(F.transform(sigs, lambda x: F.right(F.concat(F.lit("0000000"), F.hex(x)), F.lit(8))), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets; two empty sets are alike, an empty and another not."""
    both = F.size(F.array_intersect(a, b))
    return _let(both, lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n.cast("double") / (F.size(a) + F.size(b) - n)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, n_signatures: a row for each input row; null texts are empty (no signatures)."""
    sigs = docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("sigs"))
    return sigs.select("doc_id", as_text(F.col("sigs")).alias("fingerprint"), F.size("sigs").cast("long").alias("n_signatures"))


def similar(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness): pairs of fingerprints' smallest doc_ids whose likeness is at least `threshold`.

    Documents with the same set are one. Sets are partitioned by length: two lengths can
    only meet within a factor of the threshold. Each set is indexed under its rarest
    signatures, as many as a partner at the threshold can't all lack, so that common
    signatures bring no candidates together. Sets without signatures link with nothing.
    """
    sigs = docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("sigs")).where(F.size("sigs") > 0)
    sets = cut(sigs.groupBy("sigs").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("sigs")), "sets")
    rank = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    each = sets.select("id", "n", F.explode("sigs").alias("sig")).join(rank, "sig")
    order = Window.partitionBy("id").orderBy("df", "sig")
    prefix = each.withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    # partitions by length: bounds grow by 1/threshold, so partners lie in the same or the next
    bound = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9)
    left = prefix.select("sig", bound.alias("part"), F.col("id").alias("a"), F.col("n").alias("na"))
    right = prefix.select("sig", F.explode(F.array(bound, bound - 1, bound + 1)).alias("part"), F.col("id").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold)
    pairs = left.join(right, ["sig", "part"]).where(fits).select("a", "b").distinct()
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sigs").alias("sb")), "b")
    return full.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sigs with next_text, next_sigs: those of the next document by descending doc_id; after the last, of the first.

    Ids are dealt into windows along their approximate distribution, null ids by the hash of
    their text, so that no task holds all. The first document of each window is copied to the
    end of the one before: at most 2 * MAX_WINDOWS ids are broadcast for it; beyond, windows
    grow, which sort and lead() spill. Texts are shuffled once. Repeated ids follow each other
    by the hash of their text; null ids come last; a table of one row is its own next.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    base = with_ids(docs.select("doc_id", text.alias("text"))).withColumn("h", F.xxhash64("text"))
    known = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))
    n, low, some = base.agg(F.count("*"), F.percentile_approx(known, [i / ID_BINS for i in range(ID_BINS + 1)], 10_000), F.count(known)).first()
    nameless = min(MAX_WINDOWS, -(-(n - some) // WINDOW_DOCS))
    if not n:
        return base.drop("h").withColumn("sigs", signatures(F.col("text"))).selectExpr("*", "text AS next_text", "sigs AS next_sigs")
    cuts = sorted(set(low or [0]))
    each = max(1, min(MAX_WINDOWS, -(-n // WINDOW_DOCS)) // max(1, len(cuts)))
    edges = F.array(*[F.lit(x).cast("long") for x in cuts])
    seg = F.greatest(F.lit(1), F.size(F.filter(edges, lambda x: x <= F.col("doc_id"))))
    lo, hi = F.element_at(edges, F.col("seg")), F.try_element_at(edges, F.col("seg") + 1)
    inside = F.when(hi > lo, F.greatest(F.lit(0), F.least(F.lit(each - 1), F.floor((F.col("doc_id").cast("double") - lo) * F.lit(float(each)) / (hi.cast("double") - lo))))).otherwise(0)
    # null ids stand below all windows of ids, in as many of their own as they fill
    null_window = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * float(max(1, nameless))).cast("int") - max(1, nameless)
    dealt = base.withColumn("seg", seg).withColumn("win", F.when(F.col("doc_id") == NULL_ID, null_window).otherwise((F.col("seg") * each + inside).cast("int"))).drop("seg")
    firsts = sorted((r.win, r["first"].doc_id, r["first"].h) for r in dealt.groupBy("win").agg(F.max(F.struct("doc_id", "h")).alias("first")).collect())
    back = [(doc, h, firsts[(i + 1) % len(firsts)][0]) for i, (_, doc, h) in enumerate(firsts)]
    packed = F.from_json(F.lit(json.dumps([{"doc_id": a, "h": h, "ghost": b} for a, h, b in back])), "array<struct<doc_id: long, h: long, ghost: int>>")
    ghosts = spark.range(1).select(F.inline(packed))
    copies = dealt.withColumn("sigs", signatures(F.col("text"))).join(F.broadcast(ghosts), ["doc_id", "h"], "left")
    at = F.explode(F.array_compact(F.array(F.struct(F.col("win").alias("win"), F.lit(False).alias("copy")), F.when(F.col("ghost").isNotNull(), F.struct(F.col("ghost").alias("win"), F.lit(True).alias("copy"))))))
    rows = copies.select("doc_id", "h", "text", "sigs", at.alias("at")).select("doc_id", "h", "text", "sigs", "at.win", "at.copy")
    order = Window.partitionBy("win").orderBy("copy", F.desc("doc_id"), F.desc("h"), F.desc("text"))
    led = rows.select("doc_id", "text", "sigs", "copy", F.lead("text").over(order).alias("next_text"), F.lead("sigs").over(order).alias("next_sigs"))
    return null_ids(led.where("not copy").drop("copy"))


def edited(text: Column, after: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many of `after`, or all it has."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(after, F.lit(1), half))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next document's.

    Null texts are empty. One row for each input row; none for an empty table. A text without
    a common word has one signature of all its words, so it is like its equals only. A text
    of any length is one row. Other columns are not read.
    """
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sigs")).alias("fingerprint"),
        as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))
