"""SpotSigs fingerprints in DataFrame functions only: chains of content words that follow common words.

An anchor is a common word; its signature is the anchor with the next CHAIN content words (words that aren't common).
Common are the words of a list, and those that many documents of a language have. A document's fingerprint is its set of signatures. Two sets of sizes s <= t have a
Jaccard likeness of s / t at most, so that a document meets only those of sizes that the threshold admits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CHAIN = 2
#: A language's common words: at most so many, those that most of its documents have, at least this share of them; a
#: language needs so many documents for that, and the most frequent languages are looked at.
ANCHORS, SHARE, LEAST, LANGS = 100, 0.25, 20, 256
#: Common words of four languages (fixed values).
COMMON = (
    "the of and to in a is that it for on was be with as by this are from or an at not but have which "
    "de la le et les des en un une du est que qui dans pour par sur au avec pas plus ne se ce il "
    "der die und das den von zu mit sich ist auf für ein eine im dem nicht als auch es an werden "
    "el los las y por con una su para al lo como más pero sus o este"
).split()


def _words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def anchors(docs: DataFrame, by: str = "lang") -> list[str]:
    """COMMON and the common words of each language of docs (text and by; null is a language too), sorted.

    At most LANGS * ANCHORS words besides COMMON, whatever the input. Ties go to the word that comes first.
    """
    own = docs.select(F.col(by).cast("string").alias("of"), F.col("text").cast("string").alias("text"))
    w = Window.orderBy(F.desc("docs"), "of")  # one row a language; the first LANGS are kept while sorting
    langs = own.groupBy("of").agg(F.count("*").alias("docs")).filter(F.col("docs") >= LEAST).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= LANGS)
    each = own.select("of", F.explode(F.array_distinct(_words("text"))).alias("word"))
    often = each.groupBy("of", "word").agg(F.count("*").alias("has")).filter(F.col("has") >= LEAST * SHARE).join(F.broadcast(langs.select(F.col("of").alias("_of"), "docs")), F.col("of").eqNullSafe(F.col("_of")))
    best = Window.partitionBy("of").orderBy(F.desc("has"), "word")
    found = often.filter(F.col("has") >= F.col("docs") * SHARE).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= ANCHORS)
    return sorted({*COMMON, *(r["word"] for r in found.select("word").distinct().collect())})


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN, common: Sequence[str] = COMMON) -> DataFrame:
    """df with the sorted set of 64-bit signature hashes of a whole text; null and texts without a word: empty.

    Words are runs of letters and digits in lower case. Common words in a row are one anchor. A text in which no chain
    is complete has one signature, of its words as they are. Each step is a column of its own, so that none is
    evaluated twice.
    """
    words = _words(text)
    # "the of word\n": each content word ends a group that begins with the common words before it
    df = df.withColumn("_m", F.array_join(F.transform(words, lambda w: F.concat(w, F.when(w.isin(*common), " ").otherwise("\n"))), ""))
    df = df.withColumn("_g", F.split("_m", "\n")).withColumn("_c", F.col("_g"))
    for k in range(1, chain):
        later = F.slice("_g", F.lit(k + 1), F.size("_g"))
        df = df.withColumn("_c", F.zip_with("_c", later, lambda a, b: F.when(F.instr(a, " ") > 0, F.concat(a, F.lit("\n"), F.when((b != "") & ~b.endswith(" "), F.substring_index(b, " ", -1))))))
    df = df.withColumn("_h", F.array_distinct(F.transform(F.array_compact("_c"), lambda x: F.xxhash64(x))))
    whole = F.when(F.col("_m") != "", F.array(F.xxhash64("_m"))).otherwise(F.col("_h"))
    return df.withColumn(out, F.sort_array(F.when(F.size("_h") > 0, F.col("_h")).otherwise(whole))).drop("_m", "_g", "_c", "_h")


def fingerprint(sigs: Column) -> Column:
    """A set of signatures as text: its size and 128 bits of its hash."""
    return F.lower(F.concat(F.lpad(F.hex(F.size(sigs)), 6, "0"), *(F.lpad(F.hex(F.xxhash64(F.lit(i), sigs)), 16, "0") for i in (1, 2))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets, 1 for two empty ones and 0 for an empty and another one."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def with_next(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """(doc_id, text, bucket, guest, tie): docs in buckets of about `rows` by doc_id, descending within a bucket and then
    by tie, each bucket followed by the document that comes next (guest), after the last bucket by the first document of
    all.

    Bounds of up to 256 buckets are quantiles of doc_id; between two of them up to 256 equal parts are cut. A doc_id that
    is a quantile twice over has a bucket of its own, and so do nulls; a bucket of one doc_id is cut by tie, a hash of
    the text. (Equal rows stay together.) One row for each of 65,536 buckets at most is broadcast to cut them, and one
    for each part to find the guests' texts.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, least, most = own.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    least, most = least or 0, most or 0
    coarse = max(1, min(256, -(-n // rows)))
    fine = max(1, min(256, -(-n // (rows * coarse))))
    at = list(own.agg(F.percentile_approx("doc_id", [i / coarse for i in range(1, coarse)], 10_000)).first()[0] or []) if coarse > 1 else []
    often = {a for a, b in zip(at, at[1:]) if a == b}
    edges = [least, *sorted({*at, *often, *(a + 1 for a in often)} - {least}), most + 1]
    edges = [e for i, e in enumerate(edges) if not i or e > edges[i - 1]]
    listed = lambda x: F.array(*(F.lit(e).cast("long") for e in x))
    place = F.greatest(F.size(F.filter(listed(edges[:-1]), lambda e: e <= F.col("doc_id"))), F.lit(1))
    lo, hi = (F.element_at(listed(e), F.col("_place")) for e in (edges[:-1], edges[1:]))
    part = F.floor((F.col("doc_id") - lo).cast("double") * fine / F.greatest(hi - lo, F.lit(1)))
    bucket = (F.col("_place") - 1) * fine + F.least(F.greatest(part, F.lit(0)), F.lit(fine - 1)) + 1
    dealt = own.withColumn("_place", place).withColumn("_bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(bucket).cast("long")).drop("_place")
    alone = F.min("doc_id").eqNullSafe(F.max("doc_id"))
    cuts = dealt.groupBy("_bucket").agg(F.when(alone, F.ceil(F.count("*") / rows)).otherwise(1).alias("cuts"), F.count("*").alias("n"))
    cuts = cuts.select("_bucket", F.least("cuts", F.lit(65_536)).cast("long").alias("_cuts"))
    tie = F.xxhash64("text")
    cut = F.least(F.floor((tie.cast("double") / float(1 << 64) + 0.5) * F.col("_cuts")), F.col("_cuts") - 1)
    placed = dealt.join(F.broadcast(cuts), "_bucket").withColumn("tie", tie).withColumn("bucket", F.col("_bucket") * 65_536 + 65_535 - cut).drop("_bucket", "_cuts")
    w = Window.orderBy(F.desc("bucket"))  # one row a part
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = placed.groupBy("bucket").agg(F.max(F.struct("doc_id", F.bitwise_not("tie").alias("tie"))).alias("head"))
    heads = heads.withColumn("to", F.coalesce(F.lag("bucket").over(w), F.last("bucket").over(whole)))
    heads = heads.select(F.col("bucket").alias("_b"), F.col("head.doc_id").alias("_head"), F.bitwise_not("head.tie").alias("_tie"), "to")
    guests = placed.join(F.broadcast(heads), (placed["bucket"] == F.col("_b")) & placed["doc_id"].eqNullSafe(F.col("_head")) & (placed["tie"] == F.col("_tie")))
    return placed.select("doc_id", "text", "bucket", "tie", F.lit(False).alias("guest")).unionByName(guests.select("doc_id", "text", F.col("to").alias("bucket"), "tie", F.lit(True).alias("guest")))


def edited_likeness(docs: DataFrame, chain: int = CHAIN, common: Sequence[str] | None = None, rows: int = 1000) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every whole text.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, in descending order of doc_id, after the last the first. Null texts are empty; a null doc_id comes
    last; rows of one doc_id follow each other in the order of a hash of their texts. One text shuffle; a document
    of its own is its own next one; an empty table gives no rows. common: the words that are anchors, else those of
    anchors(). Other columns are ignored, whatever their names.
    """
    common = anchors(docs) if common is None else common
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "tie")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs, rows).withColumn("next", F.lead("text").over(order)).withColumn("n_chars", F.length("text"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next", F.lit(1), half)))
    rows = rows.withColumn("edited", F.when(~F.col("guest"), F.col("edited")))
    rows = with_signatures(with_signatures(rows, "text", "a", chain, common), "edited", "e", chain, common)
    rows = rows.select("doc_id", "bucket", "guest", "tie", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", "e")
    rows = rows.withColumn("b", F.lead("a").over(order)).filter("not guest")
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"),
        fingerprint(F.col("e")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("b")).alias("near_next"),
    )


def similar(docs: DataFrame, threshold: float = 0.8, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, class_id) and links (a, b, likeness) between classes with a < b.

    Documents with equal signature sets are one class, named by its smallest doc_id; copies are never compared. Two
    sets with a likeness of the threshold or more have sizes within that ratio and share one of the rarest
    signatures of either (as many as may be missing from the other, and one). Sets are dealt by size to partitions
    whose bounds grow by 1 / threshold, so that a set meets only those of its own and the next one, on a shared rare
    signature; candidates are then compared in full. Documents without a doc_id or without a word take no part.
    """
    own = with_signatures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "text", "a", chain)
    own = own.filter("doc_id is not null and size(a) > 0").select("doc_id", "a", fingerprint(F.col("a")).alias("f"))
    sets = own.groupBy("f").agg(F.min("doc_id").alias("class_id"), F.first("a").alias("a"))
    members = own.select("doc_id", "f").join(sets.select("f", "class_id"), "f").select("doc_id", "class_id")
    sets = stored(sets.select("class_id", "a", F.size("a").alias("n")))
    each = sets.select("class_id", "n", F.explode("a").alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("often")).filter("often > 1")  # the others are in one set only
    place = Window.partitionBy("class_id").orderBy("often", "sig")
    lone = sets.select("class_id", "a").join(each.join(often, "sig").groupBy("class_id").agg(F.count("*").alias("shared")), "class_id").select("class_id", (F.size("a") - F.col("shared")).alias("lone"))
    rare = each.join(often, "sig").join(lone, "class_id").withColumn("place", F.row_number().over(place) + F.col("lone"))
    rare = rare.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    rare = rare.select("sig", "class_id", "n", band.alias("band"))
    left = rare.toDF("sig", "x", "nx", "band")
    right = rare.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band")))).toDF("sig", "y", "ny", "band")
    fits = (F.col("nx") <= F.col("ny")) & (F.col("ny") * threshold <= F.col("nx") + 1e-9) & ((F.col("nx") < F.col("ny")) | (F.col("x") < F.col("y")))
    pairs = left.join(right, ["sig", "band"]).filter(fits).select("x", "y").distinct()
    both = pairs.join(sets.select(F.col("class_id").alias("x"), F.col("a").alias("ax")), "x").join(sets.select(F.col("class_id").alias("y"), F.col("a").alias("ay")), "y")
    linked = both.withColumn("likeness", likeness(F.col("ax"), F.col("ay"))).filter(F.col("likeness") >= threshold)
    return members, linked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")
