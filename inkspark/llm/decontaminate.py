"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Everything here is DataFrame and SQL functions. Words are the runs of letters and digits of the lower-cased text, shingles
are ``shingle`` words; an item of fewer words is one shingle of all of them, and documents are then also cut into shingles
of that length. An item is found in a document that holds at least ``threshold`` of the item's distinct shingles.

Search. An item's sketch is its bottom-k MinHash: its k smallest shingle hashes. A document holding ``need =
ceil(threshold * n)`` of the item's n shingles misses at most ``n - need`` of them, so with ``k = n - need + 1`` it holds a
shingle of the sketch *for certain*: k follows the item's size, the candidate search loses nothing. Items lie in size
partitions (powers of two), and a document is probed only with those partitions whose items its own size can hold.

Verification then counts, for candidate documents alone, the shared distinct shingles as strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stash import stash

#: Rows of a sketch or of a candidate table (some 16 and 100 bytes a row) that may be broadcast; more rows are shuffled.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+"), "")


def _grams(array: str, n: str, make: str) -> str:
    """SQL: ``make`` of each start i of an n-gram of ``array``; none if the array is shorter."""
    return f"IF(size({array}) >= {n}, transform(sequence(0, size({array}) - {n}), i -> {make}), array())"


def _hashes(array: str, n: int) -> str:
    """SQL: the hash of each n-gram, from the hashes of its words."""
    return _grams(array, str(n), f"xxhash64({', '.join(f'{array}[i + {k}]' for k in range(n))})")


def _strings(array: str, n: str) -> str:
    return _grams(array, n, f"array_join(slice({array}, i + 1, {n}), ' ')")


def _bound(expr: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` bound to ``expr``, which is then evaluated once a row and not once a use."""
    return f"transform(array({expr}), {name} -> {body})[0]"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_shingles(items: DataFrame, item_col: str, text_col: str, shingle: int, threshold: float) -> DataFrame:
    """``(item_id, len, n, need, size_class, grams, hashes)``: distinct shingles of each item that has words."""
    cut = stash(items.select(F.col(item_col).cast("long").alias("item_id"), words(F.col(text_col)).alias("w")), "words")
    cut = cut.where("item_id IS NOT NULL AND size(w) > 0").withColumn("len", F.least(F.size("w"), F.lit(shingle)))
    by_len = " ".join(f"WHEN {n} THEN {_hashes('h', n)}" for n in range(1, shingle + 1))
    cut = cut.selectExpr(
        "item_id", "len", f"array_distinct({_strings('w', 'len')}) AS grams", f"{_bound('transform(w, x -> xxhash64(x))', 'h', f'array_distinct(CASE len {by_len} END)')} AS hashes"
    )
    need = F.ceil(F.lit(threshold) * F.size("grams") - 1e-9).cast("int")
    return cut.withColumn("n", F.size("grams")).withColumn("need", need).withColumn("size_class", F.floor(F.log2("n")))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared, containment)`` of every item found in a document.

    Null and word-less texts and items, and rows with a null id, are never found; rows that repeat a doc_id or an item_id
    count together as one document or item (their shingles are pooled), so a pair occurs once. Other columns are not looked
    at. Empty tables give no rows. Sketches and candidate ids are broadcast up to BROADCAST_ROWS rows, else shuffled.
    """
    cut = stash(item_shingles(items, item_col, item_text_col, shingle, threshold), "items")
    lens = [r[0] for r in cut.select("len").distinct().orderBy("len").collect()]  # at most ``shingle`` numbers
    sketch = stash(
        cut.select(
            "len", "size_class", "need", F.explode(F.expr("slice(array_sort(hashes), 1, n - need + 1)")).alias("hash")
        ).groupBy("hash", "size_class").agg(F.min("need").alias("need")),
        "sketch",
    )
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), words(docs[text_col]).alias("w")).where("doc_id IS NOT NULL")
    parts = ", ".join(_hashes("h", n) for n in lens) or "array(0L)"
    hashes = _bound("transform(w, x -> xxhash64(x))", "h", f"array_distinct(concat({parts}))")
    # size and hashes come from one evaluation; the size goes along with each row
    hashed = rows.select("doc_id", F.inline(F.expr(_bound(hashes, "a", "array(struct(size(a) AS size, a AS hashes))"))))
    probe = hashed.select("doc_id", "size", F.explode("hashes").alias("hash"))
    found = probe.join(_small(sketch), "hash").where("size >= need").select("doc_id").distinct()
    found = stash(found, "candidates")

    texts = rows.join(_small(found), "doc_id", "left_semi")
    grams = ", ".join(_strings("w", str(n)) for n in lens) or "array('')"
    grams = texts.select("doc_id", F.explode(F.expr(_bound("w", "w", f"array_distinct(concat({grams}))"))).alias("gram"))
    wanted = stash(cut.select("item_id", F.explode("grams").alias("gram")).distinct(), "shingles")
    sizes = wanted.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    shared = grams.join(_small(wanted), "gram").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    return (
        shared.join(_small(stash(sizes, "sizes")), "item_id")
        .where(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_shingles") - 1e-9))
        .select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
           FROM documents WHERE text IS NOT NULL),
     i AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
           FROM benchmark WHERE text IS NOT NULL),
     ln AS (SELECT DISTINCT least(len(w), 5) AS n FROM i WHERE len(w) > 0),
     ds AS (SELECT DISTINCT id, array_to_string(w[k : k + n - 1], ' ') AS g
            FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, ln)),
     it AS (SELECT DISTINCT id, array_to_string(w[k : k + n - 1], ' ') AS g
            FROM (SELECT id, w, least(len(w), 5) AS n, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS k FROM i WHERE len(w) > 0)),
     n AS (SELECT id, count(*) AS n_shingles FROM it GROUP BY id)
SELECT ds.id AS doc_id, it.id AS item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM ds JOIN it USING (g) JOIN n ON n.id = it.id GROUP BY ds.id, it.id, n_shingles HAVING count(*) >= ceil(0.8 * n_shingles - 1e-9)
"""
