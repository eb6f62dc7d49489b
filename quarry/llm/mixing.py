"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Targets: the sources' weights share ``share`` of all words; a source gets at most ``most`` times its
own words and the excess goes to the others by weight (water level over words per weight).

Schedule: slot i holds the golden-ratio point frac(i * phi), taken to 32 bits; the cumulative block
shares of the sources map it to a source, and the slots of a source are ranked. Each source's
documents, in the order of a hash of their id, form a stream of words that is read ``most`` times
over and cut into blocks of ``block_words``. Rank k of a source joins block k of its stream; its last
block is cut at the target. The sequence's counts miss the shares by a few slots: ranks beyond a
source's blocks are dropped, missing ones follow at the end. ``mix`` names the slots of every document
and ``pieces`` gives the blocks' texts: in the order of (slot, at) they are the mix, its sources interleaved.

Ranks and offsets are sums over fixed chunks (8,192 slots; 4,096 hash buckets per source) plus a
window inside a chunk, so no window holds all rows of a source.

Defined cases: a null or text without words has size 0 and is never taken; a null source is a source
of its own, last in order; a null doc_id hashes as the empty string; equal rows lie one after the
other in the stream; with no words at all every target is 0; extra columns are kept by ``mixed``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.store import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK_WORDS = 1024
CHUNK = 8192
_PHI32 = 2654435769  # 2^32 divided by the golden ratio
_ONE = 1 << 32
_COARSE = 20  # bits of a point below its coarse cell
_PIECE = "struct<slot:bigint,at:bigint,pass:int,first_word:bigint,words:bigint>"
_FIELDS = ["slot", "at", "pass", "first_word", "words"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes (source, source_size), one row a source. Adds code (its place in code-point order, null
    last), weight and target."""
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy(F.col("cap") / F.col("weight"), "code")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("code") % len(weights) + 1).cast("int"))
    t = (sizes.withColumn("code", F.row_number().over(order) - 1).withColumn("weight", w)
         .withColumn("cap", F.col("source_size") * F.lit(float(most)))
         .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
         .withColumn("at", F.row_number().over(level))
         .withColumn("below", F.sum("cap").over(level) - F.col("cap"))
         .withColumn("left", F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("lambda", (F.col("budget") - F.col("below")) / F.col("left"))
         .withColumn("free", F.min(F.when(F.col("lambda") * F.col("weight") < F.col("cap"), F.struct("at", "lambda"))).over(everything)))
    target = F.when(F.col("free").isNull() | (F.col("at") < F.col("free.at")), F.col("cap")).otherwise(F.col("free.lambda") * F.col("weight"))
    return t.select("source", "source_size", F.col("code").cast("int").alias("code"), "weight", target.alias("target"))


def point(slot: Column) -> Column:
    """The slot's golden-ratio point times 2^32; no product leaves 63 bits."""
    low, high = F.pmod(slot, F.lit(1 << 16)), F.pmod(F.floor(slot / (1 << 16)), F.lit(1 << 16))
    return F.pmod(low * F.lit(_PHI32) + F.pmod(high * F.lit(_PHI32), F.lit(1 << 16)) * F.lit(1 << 16), F.lit(_ONE))


def schedule(spark: SparkSession, goals: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, code, rank): every source's blocks, spread evenly. ``goals``: rows of ``targets``."""
    need = goals.select("code", F.ceil(F.round("target") / block_words).cast("long").alias("blocks")).filter("blocks > 0")
    total = need.agg(F.sum("blocks")).first()[0] or 0
    acc = F.sum("blocks").over(Window.orderBy("code"))
    parts = (need.withColumn("lo", F.floor((acc - F.col("blocks")) * F.lit(float(_ONE)) / F.lit(max(total, 1))).cast("long"))
             .withColumn("hi", F.floor(acc * F.lit(float(_ONE)) / F.lit(max(total, 1))).cast("long")).filter("lo < hi"))
    cells = parts.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", _COARSE), F.shiftright(F.col("hi") - 1, _COARSE))))
    slots = (spark.range(total).withColumnRenamed("id", "slot").withColumn("u", point(F.col("slot")))
             .withColumn("cell", F.shiftright("u", _COARSE)))
    chosen = (slots.join(cells, "cell").filter("lo <= u and u < hi")
              .select("slot", F.floor(F.col("slot") / CHUNK).cast("long").alias("chunk"), "code", "blocks"))
    counts = chosen.groupBy("code", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("code", "chunk", (F.sum("n").over(Window.partitionBy("code").orderBy("chunk")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("code", "chunk").orderBy("slot"))
    ranked = (chosen.join(before, ["code", "chunk"]).withColumn("rank", (F.col("before") + inside - 1).cast("long"))
              .filter("rank < blocks").select("slot", "code", "rank"))
    have = counts.groupBy("code").agg(F.sum("n").alias("have"))
    missing = (need.join(have, "code", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < blocks")
               .withColumn("rank", F.explode(F.sequence("have", F.col("blocks") - 1))))
    tail = missing.select((F.lit(total) + F.row_number().over(Window.orderBy("rank", "code")) - 1).cast("long").alias("slot"), "code", "rank")
    return ranked.union(tail)


def _same(a: str, b: str, *columns: str) -> Column:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return cond


def mix(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """sizes: rows of ``sized``. Per row: doc_id, source, size, source_size, target, taken (words the
    mix takes), passes (words taken in each reading of the stream) and slots: in the order of the schedule,
    the pieces (slot, at, pass, first_word, words) of the document, ``at`` counting the words before it in
    its block."""
    spark = sizes.sparkSession
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = materialize(sizes.withColumn("key", key).withColumn("bucket", F.substring("key", 1, 3)), "sized")
    parts = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")), "buckets")
    goals = materialize(targets(parts.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most), "targets")
    starts = (parts.alias("p").join(goals.alias("g"), _same("p", "g", "source"))
              .select("p.source", "p.bucket", "g.code", "g.source_size", "g.target",
                      (F.sum("p.n").over(Window.partitionBy("g.code").orderBy("p.bucket")) - F.col("p.n")).alias("start")))
    inside = Window.partitionBy("code", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = materialize(
        rows.alias("r").join(starts.alias("s"), _same("r", "s", "source", "bucket"))
        .select("r.doc_id", "r.source", "r.size", "r.key", "s.bucket", "s.code", "s.source_size", "s.target", "s.start")
        .withColumn("offset", F.col("start") + F.sum("size").over(inside) - F.col("size"))
        .select("doc_id", "source", "size", "code", "source_size", "target", "offset"), "placed")
    blocks = (placed.filter("size > 0").select("code", "offset", "size", "source_size", F.round("target").cast("long").alias("goal"),
                                               F.explode(F.array(*[F.lit(e) for e in range(most)])).alias("pass"))
              .withColumn("first", F.col("offset") + F.col("pass") * F.col("source_size"))
              .withColumn("rank", F.explode(F.sequence(F.floor(F.col("first") / block_words).cast("long"),
                                                       F.floor((F.col("first") + F.col("size") - 1) / block_words).cast("long")))))
    words = (F.least(F.col("first") + F.col("size"), (F.col("rank") + 1) * F.lit(block_words), F.col("goal"))
             - F.greatest(F.col("first"), F.col("rank") * F.lit(block_words)))
    from_ = F.greatest(F.col("first"), F.col("rank") * F.lit(block_words))
    piece = F.struct("slot", (from_ - F.col("rank") * F.lit(block_words)).cast("long").alias("at"), "pass",
                     (from_ - F.col("first")).cast("long").alias("first_word"), F.col("words").cast("long").alias("words"))
    taken = (blocks.withColumn("words", words).join(schedule(spark, goals, block_words), ["code", "rank"])
             .filter("words > 0").groupBy("code", "offset")
             .agg(F.sort_array(F.collect_list(piece)).alias("slots"),
                  *[F.sum(F.when(F.col("pass") == e, F.col("words")).otherwise(0)).alias(f"pass{e}") for e in range(most)]))
    passes = F.array(*[F.coalesce(F.col(f"t.pass{e}"), F.lit(0)).cast("long") for e in range(most)])
    return (placed.alias("d").join(taken.alias("t"), (F.col("d.code") == F.col("t.code")) & (F.col("d.offset") == F.col("t.offset"))
                                   & (F.col("d.size") > 0), "left")
            .select("d.doc_id", "d.source", "d.size", "d.source_size", "d.target", passes.alias("passes"),
                    F.coalesce("t.slots", F.array().cast(f"array<{_PIECE}>")).alias("slots"))
            .withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x)))


def _planned(docs: DataFrame, id_col: str, source_col: str, text_col: str, **options) -> tuple[DataFrame, list[str]]:
    """``docs`` as d, joined with the rows of ``mix`` that take words as p, and the names of its columns in d."""
    plan = mix(sized(docs, id_col, source_col, text_col), **options).filter("taken > 0")
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(docs.columns, names)}
    d = docs.toDF(*names).withColumn("size", n_words(F.col(at[text_col])))
    same = lambda i, s: Window.partitionBy(i, s, "size").orderBy(F.lit(1))  # noqa: E731  equal sizes are taken alike
    d = d.withColumn("nth", F.row_number().over(same(at[id_col], at[source_col])))
    plan = plan.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(1))))
    both = d.alias("d").join(plan.alias("p"), F.col(f"d.{at[id_col]}").eqNullSafe(F.col("p.doc_id"))
                             & F.col(f"d.{at[source_col]}").eqNullSafe(F.col("p.source"))
                             & (F.col("d.size") == F.col("p.size")) & (F.col("d.nth") == F.col("p.nth")))
    return both, names


def _tokens(text: Column) -> Column:
    """The words of a text, each with the white space before it."""
    return F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix as documents: a row for each reading of a document that takes words of it, with the
    columns of ``docs`` (the text ends after the last word taken; n_chars follows it). Rows have no order;
    ``pieces`` has the schedule's."""
    both, names = _planned(docs, id_col, source_col, text_col, **options)
    columns = docs.columns
    at = {c: n for c, n in zip(columns, names)}
    rows = both.select(*[f"d.{n}" for n in names], "d.size", F.explode("p.passes").alias("words")).filter("words > 0")
    head = F.array_join(F.slice(_tokens(F.col(at[text_col])), F.lit(1), F.col("words").cast("int")), "")
    rows = rows.withColumn("part", F.when(F.col("words") < F.col("size"), head).otherwise(F.col(at[text_col])))
    value = {text_col: F.col("part")}
    if "n_chars" in at:
        value["n_chars"] = (F.when(F.col("words") < F.col("size"), F.length("part")).otherwise(F.col(at["n_chars"]))
                            .cast(docs.schema["n_chars"].dataType))
    return rows.select(*[value.get(c, F.col(at[c])).alias(c) for c in columns])


def pieces(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix as scheduled blocks: a row for each piece of a document in a block, with slot, at, pass,
    first_word, words and the columns of ``docs``, the text being the piece's (n_chars follows it). A piece has
    the white space before its words; a document's last one also what follows. Blocks hold ``block_words``
    words, the last of a source what its target leaves; the order of (slot, at) is that of the mix."""
    both, names = _planned(docs, id_col, source_col, text_col, **options)
    at = {c: n for c, n in zip(docs.columns, names)}
    text = F.col(at[text_col])
    # words and the end are named first, so that a text is split once and not for each of its pieces
    split = both.select(*[F.col(f"d.{n}").alias(n) for n in names], F.col("d.size").alias("size"), "p.slots").withColumn(
        "tokens", _tokens(text)).withColumn("end", F.substr(text, F.length(F.array_join("tokens", "")) + 1))
    cut = lambda p: F.concat(F.array_join(F.slice("tokens", (p["first_word"] + 1).cast("int"), p["words"].cast("int")), ""),
                             F.when(p["first_word"] + p["words"] == F.col("size"), F.col("end")).otherwise(""))
    rows = split.withColumn("piece", F.explode(F.transform("slots", lambda p: F.struct(*[p[f].alias(f) for f in _FIELDS], cut(p).alias("part")))))
    value = {text_col: F.col("piece.part")}
    if "n_chars" in at:
        value["n_chars"] = F.length("piece.part").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[F.col(f"piece.{f}").alias(f) for f in _FIELDS], *[value.get(c, F.col(at[c])).alias(c) for c in docs.columns])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
coded AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS code FROM sources),
weighed AS (SELECT *, CASE code % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                   source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM coded),
levels AS (SELECT *, row_number() OVER (ORDER BY cap / weight, code) AS pos,
                  sum(cap) OVER (ORDER BY cap / weight, code ROWS UNBOUNDED PRECEDING) - cap AS below,
                  sum(weight) OVER (ORDER BY cap / weight, code ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM weighed),
free AS (SELECT *, (budget - below) / rest AS lam FROM levels),
first_free AS (SELECT min(pos) AS pos, arg_min(lam, pos) AS lam FROM free WHERE lam * weight < cap),
goals AS (SELECT f.source, f.source_size, f.code, CASE WHEN ff.pos IS NULL OR f.pos < ff.pos THEN f.cap ELSE ff.lam * f.weight END AS target
          FROM free f CROSS JOIN first_free ff),
need AS (SELECT code, source, CAST(round(target) AS BIGINT) AS goal, CAST(ceil(round(target) / 1024) AS BIGINT) AS blocks FROM goals),
parts AS (SELECT code, blocks, sum(blocks) OVER () AS total, sum(blocks) OVER (ORDER BY code ROWS UNBOUNDED PRECEDING) AS upto FROM need WHERE blocks > 0),
cells AS (SELECT code, blocks, CAST(floor((upto - blocks) * 4294967296.0::DOUBLE / total) AS BIGINT) AS lo,
                 CAST(floor(upto * 4294967296.0::DOUBLE / total) AS BIGINT) AS hi FROM parts),
slots AS (SELECT slot, ((slot % 65536) * 2654435769 + (((slot // 65536) % 65536) * 2654435769 % 65536) * 65536) % 4294967296 AS u
          FROM (SELECT unnest(range((SELECT coalesce(max(total), 0)::BIGINT FROM parts))) AS slot) s),
ranked AS (SELECT slot, code, blocks, row_number() OVER (PARTITION BY code ORDER BY slot) - 1 AS rank FROM slots JOIN cells ON lo <= u AND u < hi),
have AS (SELECT code, count(*) AS n FROM ranked GROUP BY code),
late AS (SELECT c.code, unnest(range(coalesce(h.n, 0), c.blocks)) AS rank FROM cells c LEFT JOIN have h USING (code)),
schedule AS (SELECT code, rank, slot FROM ranked WHERE rank < blocks UNION ALL
             SELECT code, rank, (SELECT max(total) FROM parts)::BIGINT + row_number() OVER (ORDER BY rank, code) - 1 FROM late),
placed AS (SELECT row_number() OVER () AS row_id, s.doc_id, s.size, g.source_size, g.target, n.code, n.goal,
                  sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS first
           FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source JOIN need n ON n.code = g.code),
reads AS (SELECT row_id, code, goal, size, first + pass * source_size AS begun FROM placed, (SELECT unnest([0, 1]) AS pass) p WHERE size > 0),
blocks AS (SELECT row_id, code, goal, size, begun, unnest(range(CAST(begun // 1024 AS BIGINT), CAST((begun + size - 1) // 1024 + 1 AS BIGINT))) AS rank FROM reads),
pieces AS (SELECT b.row_id, s.slot, least(b.begun + b.size, (b.rank + 1) * 1024, b.goal) - greatest(b.begun, b.rank * 1024) AS words
           FROM blocks b JOIN schedule s ON s.code = b.code AND s.rank = b.rank),
taken AS (SELECT row_id, CAST(sum(words) AS BIGINT) AS taken, count(*) AS n_pieces, min(slot) AS first_slot, max(slot) AS last_slot
          FROM pieces WHERE words > 0 GROUP BY row_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, coalesce(taken, 0) AS taken, coalesce(n_pieces, 0) AS n_pieces,
       first_slot, last_slot
FROM placed LEFT JOIN taken USING (row_id)"""
