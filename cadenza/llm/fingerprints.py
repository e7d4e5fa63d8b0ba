"""Document fingerprints: SimHash by DataFrame functions, and search by permuted block tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import default_parts, stored

BITS = 64
#: Bits in which near fingerprints may differ.
RADIUS = 3
#: Shares of one fingerprint's rows where they meet the result of its search.
SALTS = 16
#: Stands for a null id in keys and order: before all others.
NO_ID = -(1 << 63)


def terms(text) -> F.Column:
    """Neighbouring words of the lower-cased text as an array of pairs; the last word stands alone."""
    words = F.split(F.lower(text), r"[\s]+")
    return F.arrays_zip(words.alias("w1"), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))).alias("w2"))


def simhash(docs: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, fingerprint long) of the texts.

    A term is a pair of neighbouring words; its weight is its number of characters, so
    common short words say little, and it counts each time it occurs. Each term's 64-bit
    hash votes with its weight for or against each bit. Two votes share one 64-bit sum,
    32 bits each, so a row needs 32 sums and a text may hold 4 billion characters. Votes
    are summed by key on the map side; one row a document is shuffled. Texts without
    words have the fingerprint 0. Rows that repeat key and text vote alike and fall
    together; equal texts have equal fingerprints.
    """
    pairs = docs.select(*keys, F.inline(terms(F.col(text_col)))).toDF(*keys, "w1", "w2")
    weight = (F.length("w1") + F.coalesce(F.length("w2"), F.lit(0))).cast("long")
    votes = pairs.select(*keys, weight.alias("w"), F.xxhash64("w1", "w2").alias("h"))
    lanes = [F.sum(F.col("w") * F.shiftrightunsigned("h", j).bitwiseAND(F.lit(0x100000001))).alias(f"s{j}") for j in range(32)]
    sums = votes.groupBy(*keys).agg(F.sum("w").alias("w"), *lanes)
    bits = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"s{j}", 32)
        for place, vote in ((j, low), (j + 32, high)):
            mask = 1 << place if place < 63 else -(1 << 63)
            bits = bits.bitwiseOR(F.when(2 * vote > F.col("w"), F.lit(mask)).otherwise(F.lit(0)).cast("long"))
    return sums.select(*keys, bits.alias("fingerprint"))


def likeness(a, b) -> F.Column:
    """Share of equal bits of two fingerprints."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_hex(fingerprint) -> F.Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def next_in_order(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """(order columns of each distinct row, ``copies``, ``before``: the columns of the row before it), round to the last.

    ``rows`` are numbers only. They are dealt to ranges of about equal numbers of rows, whatever
    the gaps between the values; windows run inside a range, and only the ends of the
    ranges, one row each, meet in one task.
    """
    parts = parts or 4 * default_parts(rows.sparkSession)
    once = rows.groupBy(*order).agg(F.count("*").alias("copies"))
    cut = stored(once.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "fingerprint-order")
    me = F.struct(*order)
    lasts = cut.groupBy("part").agg(F.max(me).alias("last"))
    every = Window.partitionBy(F.lit(0)).orderBy("part")  # at most parts rows
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = lasts.select("part", F.coalesce(F.lag("last").over(every), F.last("last").over(whole)).alias("edge"))
    inside = cut.withColumn("before", F.lag(me).over(Window.partitionBy("part").orderBy(*order)))
    return inside.join(F.broadcast(lasts), "part").select(*order, "copies", F.coalesce("before", "edge").alias("before"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """(id, th, text, n_chars, edited, next_id, next_th, copies) of the distinct rows of ``docs(id, th, text)``.

    The last quarter of a text (n_chars // 4 code points) gives way to the first as many
    of the next one by (id, th). Only those prefixes move besides the texts themselves,
    which are shuffled once and used twice.
    """
    sized = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    order = next_in_order(sized.select("id", "th"), ["id", "th"])
    sizes = sized.select("id", "th", "n_chars").distinct()
    need = order.select("id", "th", F.col("before.id").alias("b_id"), F.col("before.th").alias("b_th"))
    need = need.join(sizes.toDF("b_id", "b_th", "b_chars"), ["b_id", "b_th"])
    dealt = docs.repartition(default_parts(docs.sparkSession), "id", "th")
    heads = dealt.join(need, ["id", "th"]).select(F.col("b_id").alias("id"), F.col("b_th").alias("th"), F.expr("substring(text, 1, cast(b_chars div 4 as int))").alias("head"), F.col("id").alias("next_id"), F.col("th").alias("next_th"))
    heads = heads.dropDuplicates(["id", "th"])
    both = dealt.join(heads, ["id", "th"]).join(order.select("id", "th", "copies"), ["id", "th"]).withColumn("n_chars", F.char_length("text").cast("long"))
    return both.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), head)"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    A null text counts as empty. Rows that repeat id and text stand at one place of the order
    and get equal results, a row each; rows with one id and different texts are documents of
    their own, in the order of a hash of the text. A null id comes first. A single document
    is followed by itself. A very long text is counted by its terms; other columns are ignored;
    an empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    keys = ["id", "th", "next_id", "next_th", "n_chars", "sha", "copies"]
    both = edited_texts(rows).withColumn("sha", F.sha2("edited", 256))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body"))))
    hashed = simhash(both.select(*keys, kinds.alias("x")).select(*keys, "x.kind", "x.body"), [*keys, "kind"], "body")
    wide = hashed.groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("a"), F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("b"))
    wide = stored(wide, "fingerprints")  # a small row a document; else the votes would be counted twice
    follow = wide.select(F.col("id").alias("next_id"), F.col("th").alias("next_th"), F.col("a").alias("n"))
    out = wide.join(follow, ["next_id", "next_th"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    doc_id = F.when(F.col("id") > NO_ID, F.col("id"))
    return out.select(
        doc_id.alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), as_hex("a").alias("fingerprint"), as_hex("b").alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("n")).alias("near_next"),
    )


def search_fingerprints(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Pairs (a, b, distance) of distinct fingerprints, a of ``queries`` and b <> a of ``prints``, within the Hamming ``radius``.

    The 64 bits are cut into ``blocks``. Fingerprints within the radius agree in all bits
    of at least ``blocks - radius`` blocks, so one table for each choice of that many
    blocks, keyed by their bits, finds every pair; a pair is reported by the first table
    that finds it. More blocks give longer keys and fewer candidates, but more tables.
    Equal fingerprints are collapsed first; callers keep the membership.
    """
    blocks = blocks or radius + 3
    if blocks <= radius:
        raise ValueError("blocks must exceed the radius")
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]

    def mask(chosen):
        bits = sum(((1 << (cuts[c + 1] - cuts[c])) - 1) << cuts[c] for c in chosen)
        return bits - (1 << 64) if bits >> 63 else bits

    masks = [mask(c) for c in combinations(range(blocks), blocks - radius)]

    def table(frame, name):
        keyed = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(name).bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(masks)]))
        return frame.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct().select(name, keyed.alias("k")).select(name, "k.t", "k.key")

    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(len(masks))
    for t in reversed(range(len(masks))):
        first = F.when(differ.bitwiseAND(F.lit(masks[t]).cast("long")) == 0, F.lit(t)).otherwise(first)
    found = table(queries, "a").join(table(prints, "b"), ["t", "key"]).where((F.col("a") != F.col("b")) & (F.bit_count(differ) <= radius) & (F.col("t") == first))
    return found.select("a", "b", F.bit_count(differ).alias("distance"))


def near_fingerprints(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """All pairs (a, b, distance) of distinct fingerprints, a < b, within the Hamming ``radius``."""
    return search_fingerprints(prints, prints, radius, blocks).where("a < b")


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and a search of the block tables.

    ``n_near`` is the number of other fingerprints within three bits of a document's, for the
    documents whose id is divisible by 50, which are searched for among all; null for the rest.
    """
    from cadenza.llm.common import table

    found = stored(fingerprint_documents(table(spark, sf_dir, "documents")), "fingerprints-found")
    bits = F.conv("fingerprint", 16, -10).cast("long")
    asked = found.where("doc_id % 50 = 0").select("fingerprint").distinct()
    pairs = search_fingerprints(asked.select(bits.alias("fingerprint")), found.select(bits.alias("fingerprint")))
    near = pairs.groupBy("a").agg(F.count("*").alias("n")).select(as_hex("a").alias("fingerprint"), "n")
    counts = asked.join(near, "fingerprint", "left").select("fingerprint", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    # Only the rows asked for meet their counts, dealt by salt as one fingerprint may have very many rows.
    is_asked = F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))
    salted = found.where(is_asked).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS).cast("long")))
    counted = salted.join(counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["fingerprint", "salt"])
    rest = found.where(~is_asked).select(*found.columns, F.lit(None).cast("long").alias("n_near"))
    return counted.select(*found.columns, F.col("n").alias("n_near")).unionByName(rest)
