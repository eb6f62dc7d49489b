"""Administrative hierarchy operators (A1-A8) and geography extraction from data.

The dimension has the schema ADM1_EN, ADM2_EN, ADM2_PCODE, ADM2_TYPE, ADM3_EN, ADM3_PCODE.
"First row" rules of the reference become deterministic aggregates (min_by on a key);
random samples become md5-ordered top-n, which Spark plans as a per-task group limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Name fragments per geographic level.
REGION_FRAGMENTS = ["région", "region", "district"]
COMMUNE_FRAGMENTS = ["commune", "localité", "locality"]
VILLAGE_FRAGMENTS = ["village", "fokontany", "fokont"]
GPS_FRAGMENTS = ["latitude", "longitude", "gps", "coord"]

# Context words (A4).
RURAL_WORDS = ["rural", "campagne", "village"]
URBAN_WORDS = ["urbain", "ville", "centre"]
RURAL_EXCLUDE = "1er|2e|3e|4e|5e|6e"
URBAN_INCLUDE = "1er|2e|3e"

# Alias expansion and "whole country" keywords (A5).
ALIASES = {
    "tana": ["antananarivo", "analamanga", "1er arrondissement"],
    "antananarivo": ["antananarivo", "analamanga"],
    "fianar": ["fianarantsoa", "haute matsiatra"],
    "fianarantsoa": ["fianarantsoa", "haute matsiatra"],
    "tamatave": ["toamasina", "atsinanana"],
    "toamasina": ["toamasina", "atsinanana"],
    "majunga": ["mahajanga", "boeny"],
    "mahajanga": ["mahajanga", "boeny"],
    "tulear": ["toliara", "atsimo andrefana"],
    "toliara": ["toliara", "atsimo andrefana", "toliary"],
    "antsiranana": ["antsiranana", "diana"],
    "diego": ["antsiranana", "diana", "diego"],
    "fort-dauphin": ["taolagnaro", "anosy"],
    "fort dauphin": ["taolagnaro", "anosy"],
    "sava": ["sava", "sambava", "antalaha", "vohemar", "andapa"],
    "nosy be": ["nosy-be", "diana"],
    "sainte marie": ["sainte marie", "analanjirofo"],
    "ste marie": ["sainte marie", "analanjirofo"],
}
NATIONAL_KEYWORDS = ["partout", "national", "nationale", "toute l'ile", "toute l'île",
                     "tout madagascar", "ensemble de madagascar", "dans tout le pays"]
# Words that are not searched, and the region drawn from without a hit.
SKIP_WORDS = ["madagascar", "mada"]
DEFAULT_REGION = "Haute Matsiatra"


# ---------------------------------------------------------------- P15


def level_columns(columns: list[str]) -> dict[str, list[str]]:
    low = {c: c.lower() for c in columns}
    pick = lambda frags: [c for c in columns if any(f in low[c] for f in frags)]
    return {"region": pick(REGION_FRAGMENTS), "commune": pick(COMMUNE_FRAGMENTS),
            "village": pick(VILLAGE_FRAGMENTS), "gps": pick(GPS_FRAGMENTS)}


def extract_locations(df: DataFrame, limits: dict | None = None) -> DataFrame:
    """Distinct trimmed values of the name-matched columns per level, sorted, first
    3 regions / 5 communes / 5 villages. (level, rank, value, has_gps)"""
    limits = limits or {"region": 3, "commune": 5, "village": 5}
    lv = level_columns(df.columns)
    own = [(level, F.col(f"`{c}`").cast("string")) for level, cols in lv.items() if level != "gps" for c in cols]
    has_gps = bool(lv["gps"])
    if not own:
        return df.sparkSession.createDataFrame([], "level string, rank int, value string, has_gps boolean")
    # one scan for all matched columns: a row holds one value of each
    cells = F.array(*[F.struct(F.lit(level).alias("level"), v.alias("value")) for level, v in own])
    allv = (df.select(F.explode(cells).alias("c")).select("c.level", "c.value").filter("value is not null and value != ''")
            .select("level", F.trim("value").alias("value")))
    lim = F.lit(None).cast("int")
    for level, k in limits.items():
        lim = F.when(F.col("level") == level, F.lit(k)).otherwise(lim)
    w = Window.partitionBy("level").orderBy("value")
    # the literal bound lets Spark plan a per-task group limit before the shuffle; the
    # per-level bound is applied after it
    return (allv.distinct().withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= max(limits.values())).filter(F.col("rank") <= lim)
            .withColumn("has_gps", F.lit(has_gps)))


# ---------------------------------------------------------------- A1 - A4, A6 - A8


def regions(dim: DataFrame) -> DataFrame:
    """A1."""
    return dim.select("ADM1_EN").distinct()


def districts(dim: DataFrame, adm1: str | None = None) -> DataFrame:
    """A2: one row per ADM2_PCODE (the row with the smallest ADM3_PCODE stands for 'first')."""
    d = dim if adm1 is None else dim.filter(F.col("ADM1_EN") == adm1)
    rec = F.min_by(F.struct("ADM2_EN", "ADM2_TYPE", "ADM1_EN"), F.col("ADM3_PCODE"))
    return (d.groupBy("ADM2_PCODE").agg(rec.alias("r"))
            .select(F.col("ADM2_PCODE").alias("pcode"), F.col("r.ADM2_EN").alias("name"),
                    F.col("r.ADM2_TYPE").alias("type"), F.col("r.ADM1_EN").alias("adm1")))


def localities(dim: DataFrame, adm1: str | None = None, adm2: str | None = None) -> DataFrame:
    """A3."""
    d = dim
    if adm1:
        d = d.filter(F.col("ADM1_EN") == adm1)
    if adm2:
        d = d.filter(F.col("ADM2_EN") == adm2)
    return d.select(F.col("ADM3_PCODE").alias("pcode"), F.col("ADM3_EN").alias("name"),
                    F.col("ADM2_EN").alias("adm2"), F.col("ADM1_EN").alias("adm1"),
                    F.col("ADM2_TYPE").alias("adm2_type"))


def context_mode(text):
    low = F.lower(text)
    rural = F.lit(False)
    for w in RURAL_WORDS:
        rural = rural | low.contains(w)
    urban = F.lit(False)
    for w in URBAN_WORDS:
        urban = urban | low.contains(w)
    return F.when(rural, F.lit("rural")).when(urban, F.lit("urban")).otherwise(F.lit("all"))


def context_locations(dim: DataFrame, contexts: DataFrame, text_col: str, key_col: str,
                      n: int = 5) -> DataFrame:
    """A4 as a table job: each context text gets the first n distinct localities (by pcode)
    of its mode (rural / urban / all). The three candidate lists hold n rows each, so the
    join to the contexts is a broadcast of at most 3n rows."""
    first = (dim.groupBy("ADM3_PCODE").agg(F.min_by(F.struct("ADM3_EN", "ADM2_EN", "ADM1_EN", "ADM2_TYPE"),
                                                    F.col("ADM2_PCODE")).alias("r")))
    first = first.select("ADM3_PCODE", "r.*")
    rural = first.filter(~F.col("ADM2_EN").rlike(RURAL_EXCLUDE)).withColumn("mode", F.lit("rural"))
    urban = first.filter(F.col("ADM2_EN").rlike(URBAN_INCLUDE)).withColumn("mode", F.lit("urban"))
    every = first.withColumn("mode", F.lit("all"))
    w = Window.partitionBy("mode").orderBy("ADM3_PCODE")
    cand = (rural.unionByName(urban).unionByName(every).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= n))
    ctx = contexts.select(F.col(key_col).alias("key"), context_mode(F.col(text_col)).alias("mode"))
    return ctx.join(F.broadcast(cand), "mode").select(
        "key", "mode", "rank", F.col("ADM3_PCODE").alias("pcode"), F.col("ADM3_EN").alias("name"),
        F.col("ADM2_EN").alias("adm2"), F.col("ADM1_EN").alias("adm1"), F.col("ADM2_TYPE").alias("adm2_type"))


def zone_filter(dim: DataFrame, zones: list[str]) -> DataFrame:
    """Rows whose level-1 or level-2 name is one of the zones; all rows when none match."""
    hit = dim.filter(F.col("ADM1_EN").isin(zones) | F.col("ADM2_EN").isin(zones))
    return hit if hit.limit(1).count() else dim


def statistics(dim: DataFrame) -> DataFrame:
    """Distinct counts per level."""
    return dim.agg(F.count_distinct("ADM3_PCODE").alias("total_locations_adm3"),
                   F.count_distinct("ADM2_PCODE").alias("total_districts_adm2"),
                   F.count_distinct("ADM1_EN").alias("total_regions_adm1"))


def hierarchy_index(dim: DataFrame) -> DataFrame:
    """Region -> districts (sorted) with their locality counts. The per-region list
    holds districts, not localities, so its size is bounded by the hierarchy's fan-out."""
    d = (dim.groupBy("ADM1_EN", "ADM2_PCODE", "ADM2_EN")
         .agg(F.count_distinct("ADM3_PCODE").alias("n_localities")))
    return (d.groupBy("ADM1_EN").agg(
        F.array_sort(F.collect_list(F.struct("ADM2_EN", "ADM2_PCODE", "n_localities"))).alias("districts"),
        F.sum("n_localities").alias("n_localities")))


def district_localities(dim: DataFrame) -> DataFrame:
    """The localities of every district, one distinct row each (adm2, pcode, name, adm1); rows without a
    region or district name are left out. A long table: a district's list may be of any length."""
    named = (F.coalesce(F.col("ADM1_EN"), F.lit("")) != "") & (F.coalesce(F.col("ADM2_EN"), F.lit("")) != "")
    return dim.filter(named).select(F.col("ADM2_EN").alias("adm2"), F.col("ADM3_PCODE").alias("pcode"), F.col("ADM3_EN").alias("name"),
                                    F.col("ADM1_EN").alias("adm1")).distinct()


def locality_details(dim: DataFrame) -> DataFrame:
    """One entry per locality name (adm3, pcode, adm1, adm2); of several the one of the smallest code."""
    rows = district_localities(dim)
    return (rows.groupBy(F.col("name").alias("adm3")).agg(F.min(F.struct("pcode", "adm1", "adm2")).alias("e"))
            .select("adm3", "e.pcode", "e.adm1", "e.adm2"))


# ---------------------------------------------------------------- A5


def search_terms(queries: DataFrame, text_col: str, key_col: str) -> DataFrame:
    """A5 step 1: (key, national, term) -- words longer than 3 chars, country names skipped,
    aliases expanded; national queries get no terms."""
    low = F.lower(F.trim(F.col(text_col)))
    national = F.lit(False)
    for k in NATIONAL_KEYWORDS:
        national = national | low.contains(k)
    words = (queries.select(F.col(key_col).alias("key"), national.alias("national"),
                            F.posexplode_outer(F.split(F.regexp_replace(low, ",", " "), r"\s+")).alias("pos", "word"))
             .filter((F.length("word") > 3) & ~F.col("word").isin(SKIP_WORDS) & ~F.col("national")))
    alias_rows = [(k, i, t) for k, ts in ALIASES.items() for i, t in enumerate(ts)]
    amap = queries.sparkSession.createDataFrame(alias_rows, "word string, apos int, term string")
    terms = (words.join(F.broadcast(amap), "word", "left")
             .select("key", "national", "pos", F.coalesce("apos", F.lit(0)).alias("apos"),
                     F.coalesce("term", "word").alias("term")))
    flags = queries.select(F.col(key_col).alias("key"), national.alias("national"))
    return terms, flags


def _trigrams(c):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, 3)))


def term_matches(terms: DataFrame, loc: DataFrame, n: int) -> DataFrame:
    """(term, locality columns): per distinct term the n localities, first by md5 of their code, that
    hold it in any level name, case-insensitively. A name holds a term only if it has all its trigrams,
    so terms join names on their rarest one and ``contains`` confirms; the rows grow with the terms and
    the names of one rare trigram each, not with the requests."""
    hits = term_candidates(terms, loc).filter(F.col("hay").contains(F.col("term")))
    w = Window.partitionBy("term").orderBy(F.md5(F.col("ADM3_PCODE")), "ADM3_PCODE")
    return (hits.select("term", *loc.columns, F.row_number().over(w).alias("r")).filter(F.col("r") <= n).drop("r"))


#: Parts that the names of one trigram are dealt to, so that a name all places share is no single task's.
PARTS = 64


def term_candidates(terms: DataFrame, loc: DataFrame) -> DataFrame:
    """(term, hay, locality columns): the names that hold a term's rarest trigram. Only trigrams that are some term's
    rarest move (their list is broadcast: no more than the trigrams of the alphabet), and those in PARTS parts."""
    t = terms.select(F.lower(F.col("term")).alias("term")).distinct()
    names = loc.withColumn("hay", F.lower(F.concat_ws("\u0001", "ADM1_EN", "ADM2_EN", "ADM3_EN")))
    grams = names.withColumn("tri", F.explode(_trigrams(F.col("hay"))))
    often = grams.groupBy("tri").agg(F.count(F.lit(1)).alias("names"))
    rarest = (t.withColumn("tri", F.explode(_trigrams(F.col("term")))).join(often, "tri")
              .groupBy("term").agg(F.min_by("tri", F.struct("names", "tri")).alias("tri")))
    wanted = grams.join(F.broadcast(rarest.select("tri").distinct()), "tri", "left_semi")
    wanted = wanted.withColumn("part", F.pmod(F.xxhash64("hay", "ADM3_PCODE"), F.lit(PARTS)))
    every = rarest.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>")))
    return every.join(wanted, ["tri", "part"])


def alias_search(dim: DataFrame, queries: DataFrame, text_col: str, key_col: str, n: int = 5,
                 default_region: str = DEFAULT_REGION) -> DataFrame:
    """A5 as a table job. Distinct terms are matched to localities once, n each (see term_matches), and
    those rows join the requests, so the join's output is at most n per term and request. Queries
    without hits (or without terms) fall back to the default region; national queries draw from all
    rows. The sample is the first n per query by md5 of the locality's code, returned sorted by name."""
    terms, flags = search_terms(queries, text_col, key_col)
    loc = dim.select("ADM3_PCODE", "ADM3_EN", "ADM1_EN", "ADM2_EN")
    by_term = (terms.select("key", F.lower(F.col("term")).alias("term")).distinct()
               .join(term_matches(terms, loc, n), "term").drop("term").distinct())
    keys_hit = by_term.select("key").distinct()
    default_rows = loc.filter(F.lower(F.col("ADM1_EN")).contains(default_region.lower()))
    nat_keys = flags.filter("national").select("key")
    nonnat = flags.filter(~F.col("national")).select("key")
    fallback_keys = nonnat.join(keys_hit, "key", "left_anti")
    # national and fallback queries draw from one shared pool each; the pool is cut to its
    # n md5-first rows before the join, so the join emits exactly the n result rows per key.
    parts = [by_term]
    pools = []
    for mode, pool in (("national", loc), ("default", default_rows)):
        # top-n by hash: planned as a per-task top-n then a merge of n rows per task
        pools.append(pool.orderBy(F.md5(F.col("ADM3_PCODE")), "ADM3_PCODE").limit(n)
                     .withColumn("mode", F.lit(mode)))
    pool_rows = pools[0].unionByName(pools[1])
    keyed = (nat_keys.withColumn("mode", F.lit("national"))
             .unionByName(fallback_keys.withColumn("mode", F.lit("default"))))
    parts.append(keyed.join(F.broadcast(pool_rows), "mode").drop("mode"))
    cand = parts[0]
    for p in parts[1:]:
        cand = cand.unionByName(p)
    w = Window.partitionBy("key").orderBy(F.md5(F.col("ADM3_PCODE")), "ADM3_PCODE")
    picked = cand.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    w2 = Window.partitionBy("key").orderBy("ADM3_EN", "ADM3_PCODE")
    return picked.select("key", F.row_number().over(w2).alias("rank"),
                         F.col("ADM3_PCODE").alias("pcode"), F.col("ADM3_EN").alias("name"),
                         F.col("ADM1_EN").alias("adm1"), F.col("ADM2_EN").alias("adm2"))
