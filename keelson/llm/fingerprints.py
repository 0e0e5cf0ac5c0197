"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

Sections are divided by blank lines, paragraphs by line ends, and a paragraph's leaves are its
sentences (or blocks of ``LEAF`` characters of sentences that run on). Leaves and paragraphs have a
digest, a section digests its paragraphs, and the root its sections. Two texts are
equal if their roots are; where roots differ, only branches with differing digests need be followed
to find the edit. All of it is built from SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters of a leaf without a sentence end; hex digits of a leaf's and an inner digest.
LEAF, LEAF_DIGITS, INNER_DIGITS = 120, 12, 16
LEAVES = rf"[^.!?]{{0,{LEAF}}}+[.!?]+|[^.!?]{{1,{LEAF}}}"
#: Documents of one bucket when neighbours are looked up, and buckets at most.
BUCKET_DOCS, MAX_BUCKETS = 400, 4096


def tree(text: Column) -> Column:
    """Paragraphs by section: arrays of (d: SHA-256, l: leaf digests). A null text is empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    digest = lambda leaf: F.substring(F.lower(F.hex(F.xxhash64(leaf))), 1, LEAF_DIGITS)
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAVES), F.lit(0)), digest)
    paragraph = lambda p: F.struct(F.sha2(p, 256).alias("d"), leaves(p).alias("l"))
    return F.transform(F.split(whole, "\n\n"), lambda section: F.transform(F.split(section, "\n"), paragraph))


def fingerprint(nodes: Column) -> Column:
    """The tree as one string: the root, then each section's digest with its paragraphs' leaves.

    ``root#section:leaf,leaf;leaf,leaf#section:...`` with ``;`` between paragraphs. A section's digest
    is the SHA-256 of its paragraphs', the root that of its sections'; the string holds the first
    ``INNER_DIGITS`` of a section's.
    """
    digests = F.transform(nodes, lambda s: F.sha2(F.array_join(s["d"], ";"), 256))
    leaves = F.transform(nodes, lambda s: F.array_join(F.transform(s, lambda p: F.array_join(p["l"], ",")), ";"))
    shown = F.zip_with(digests, leaves, lambda d, l: F.concat(F.substring(d, 1, INNER_DIGITS), F.lit(":"), l))
    return F.concat(F.sha2(F.array_join(digests, "#"), 256), F.lit("#"), F.array_join(shown, "#"))


def leaf_list(nodes: Column) -> Column:
    """All leaf digests of a tree, each as often as it stands in the text."""
    return F.flatten(F.flatten(nodes)["l"])


def likeness(a: Column, b: Column) -> Column:
    """Shared leaves of two leaf lists, 0 to 1: twice the common ones by the sum of both; two empty lists are alike.

    A leaf counts as often as both have it. The sorted leaves of both are gone through once: a leaf's places in ``a``
    come first, and each one in ``b`` takes one of them.
    """
    both = F.size(a) + F.size(b)
    marked = lambda leaves, side: F.transform(leaves, lambda x: F.concat(x, F.lit(f" {side}")))

    def step(at: Column, x: Column) -> Column:
        leaf, own = F.substring_index(x, " ", 1), x.endswith("a")
        free = F.when(leaf == at["leaf"], at["free"]).otherwise(0)
        return F.struct(
            leaf.alias("leaf"), F.when(own, free + 1).otherwise(F.greatest(free - 1, F.lit(0))).alias("free"),
            (at["common"] + F.when(own | (free == 0), 0).otherwise(1)).alias("common"),
        )

    start = F.struct(F.lit("").alias("leaf"), F.lit(0).alias("free"), F.lit(0).alias("common"))
    common = F.aggregate(F.sort_array(F.concat(marked(a, "a"), marked(b, "b"))), start, step, lambda at: at["common"])
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * common / both)


def beside_next(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row with ``_next``: the text of the next document by ascending doc_id.

    The last one's next is the first. Rows are dealt by doc_id into buckets whose bounds are actual
    ids, and the rows at a bound are also sent to the bucket before, so that a window within a bucket
    sees the neighbour of its last row. Null ids come first; equal ids are ordered by their text, and
    among equal rows any order holds.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, least, nulls = rows.agg(F.count("*"), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    buckets = max(1, min(MAX_BUCKETS, n // BUCKET_DOCS))
    shares = [i / buckets for i in range(1, buckets)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 10 * MAX_BUCKETS).alias("p")).first()["p"] if shares else []
    bounds = sorted({b for b in found or [] if b > least or nulls})
    last = len(bounds)
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(edges, lambda b: b <= F.col("doc_id"))))
    # A bucket's first documents again at the end of the bucket before; the very first at the end of the last.
    first = F.col("doc_id").isNull() if nulls else F.col("doc_id").eqNullSafe(F.lit(least).cast("long"))
    at = lambda b, copy: F.struct(b.cast("int").alias("bucket"), F.lit(copy).alias("copy"))
    places = F.array(at(bucket, 0))
    if bounds:
        places = F.when(F.array_contains(edges, F.coalesce(F.col("doc_id"), F.lit(least or 0).cast("long"))) & F.col("doc_id").isNotNull(), F.array(at(bucket, 0), at(bucket - 1, 1))).otherwise(places)
    places = F.when(first, F.concat(places, F.array(at(F.lit(last), 2)))).otherwise(places)
    placed = rows.select("doc_id", "text", F.explode(places).alias("_place"))
    line = Window.partitionBy("_place.bucket").orderBy("_place.copy", F.col("doc_id").asc_nulls_first(), "text")
    return placed.withColumn("_next", F.lead("text").over(line)).where(F.col("_place.copy") == 0).select("doc_id", "text", "_next")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter of characters replaced by the first as many of ``following``."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - quarter).cast("int")), F.substring(following, F.lit(1), quarter))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (likeness
    of its fingerprint to the edited text's and to the next document's), and edited_branches: the
    paragraphs of the edited tree whose digests the document's own tree lacks, as [section, paragraph].
    Null texts count as empty. A single document is its own next. Other columns are ignored.
    """
    beside = beside_next(docs).withColumn("_edited", edited(F.col("text"), F.col("_next")))
    trees = beside.select(
        "doc_id", "text", "_edited",
        tree(F.col("text")).alias("_tree"), tree(F.col("_edited")).alias("_etree"),
        leaf_list(tree(F.col("_next"))).alias("_nleaves"),
    )
    leaves = leaf_list(F.col("_tree"))
    known = F.flatten(F.col("_tree"))["d"]
    differing = F.flatten(
        F.transform(
            F.col("_etree"),
            lambda s, i: F.filter(
                F.transform(s, lambda p, j: F.when(~F.array_contains(known, p["d"]), F.array(i, j))), lambda x: x.isNotNull()
            ),
        )
    )
    return trees.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint(F.col("_tree")).alias("fingerprint"),
        fingerprint(F.col("_etree")).alias("edited_fingerprint"),
        likeness(leaves, leaf_list(F.col("_etree"))).alias("near_edited"),
        likeness(leaves, F.col("_nleaves")).alias("near_next"),
        differing.alias("edited_branches"),
    )
