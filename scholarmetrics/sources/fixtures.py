"""Test inputs: a publication corpus derived from the driver's TPC-H-like tables.

Mapping (see FIXTURES.md): paper = order, author slot = line item, author =
part, affiliation = supplier of the slot, journal = supplier of the first
slot, subject tree = nation -> region. The corpus is nested exactly like the
production input (authors, author-affiliation links and affiliations as arrays
of structs per paper, references as an array of ids); the oracle SQL derives
the same facts as flat views.

Every derived table is a join or aggregation over the whole input tables with
bounded fan-out: references are drawn from fixed key offsets, the first paper
of the same author and ids outside the corpus, never from all pairs of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from .inputs import Inputs

# Fixed values of the fixture derivation (shared with the oracle SQL).
CORE_PRIORITY_TYPES = {"1": "ar", "2": "cp", "3": "re", "4": "ed"}  # anything else: "le"
OTHER_TYPE = "le"
REFERENCE_OFFSETS = (1, 2, 3, 5, 8, 13, 21, 34)
REFERENCE_BLOCK = 4096  # keys of a block in which references are looked up
OUTSIDE_ID_BASE = 1_000_000_000
NULL_AUTHOR_MOD = 211  # papers whose author ids are malformed
NO_AFFIL_ID_MOD, NO_AFFIL_ID_REST = 19, 4  # suppliers whose affiliation records have no id
BAD_AFFIL_SEQ_MOD = 97  # papers whose author-affiliation links point past the end
BAD_AFFIL_SEQ = 99

# Run configurations used by the registered queries (data span 1995-01 .. 2001-08).
_FIXTURE_COMMON = dict(top_n=100, top_frac=0.02, min_core_papers=5, min_papers=2, min_classified=1, auid_floor=4)
CAREER = Config(name="career", min_year=1996, min_cite_year=1997, max_year=2000, **_FIXTURE_COMMON)
SINGLE_YEAR = Config(name="single_year", min_year=1996, min_cite_year=2000, max_year=2000, **_FIXTURE_COMMON)
EDITION2017 = Config(
    name="edition2017", min_year=1996, min_cite_year=1997, max_year=2000, edition="2017",
    **{**_FIXTURE_COMMON, "min_classified": 5, "auid_floor": None},
)
# authored span 1995 only, citers from 2001 only, low eligibility bar: authors
# without citations (sf0.01: 118), with only self-citations (17), without a
# classified paper (15) or a second subfield (519), below two papers (49)
SPARSE = Config(name="sparse", min_year=1995, min_cite_year=2001, max_year=1995, **{**_FIXTURE_COMMON, "min_core_papers": 1})


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


_BUILT: dict[tuple[str, str, str], Inputs] = {}  # per application, data and stage namespace


def build_inputs(spark: SparkSession, sf_dir: str, materialize: bool = True) -> Inputs:
    """The input tables derived from ``sf_dir``; with ``materialize`` each is written
    once to the shared folder (like the production inputs, which are parquet
    tables) and read back, so that queries scan it instead of re-deriving it. A session
    plans them once per state of the files."""
    if not materialize:
        return _derive(spark, sf_dir)
    from . import io

    files = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("lineitem", "orders", "part", "supplier", "nation", "region")]
    key = f"fixture|{sf_dir}|{io.input_fingerprint(spark, *files)}"
    known = (spark.sparkContext.applicationId, key, io.STAGE_NAMESPACE)
    if known not in _BUILT:
        raw = _derive(spark, sf_dir)
        corpus = io.stage(spark, lambda: raw.corpus, "input_corpus", key)
        # the per-paper subjects derive from the written corpus, not from its plan again
        smc = _smc(corpus, _read(spark, sf_dir, "supplier"), raw.subject_tree)
        frames = {**raw.tables(), "corpus": corpus, "smc": smc}
        _BUILT[known] = Inputs(**{
            name: df if name == "corpus" else io.stage(spark, (lambda df=df: df), f"input_{name}", key)
            for name, df in frames.items()
        }, key=key)
    return _BUILT[known]


def _smc(corpus: DataFrame, supplier: DataFrame, tree: DataFrame) -> DataFrame:
    return (
        corpus.select("eid", F.col("source.srcid").alias("srcid"))
        .filter((F.col("srcid") % 10 != 9) & (F.col("eid") % 29 != 0))
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("srcid"))
        .withColumn("code", (F.col("s_nationkey") + F.when(F.col("eid") % 7 == 0, 1).otherwise(0)) % 25)
        .join(tree, F.col("code") == F.col("subfield_code"))
        .select("eid", "subfield", "field", "domain")
    )


def _repeats(df: DataFrame, key: str) -> bool:
    """Whether a key has several rows."""
    return not df.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > 1).isEmpty()


def _derive(spark: SparkSession, sf_dir: str) -> Inputs:
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"
    )
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    supplier = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")

    # ---- author slots, nested per paper -------------------------------------------------
    # price and date tell two equal slots of a paper apart; that shows in the names alone, where a key has
    # several, so otherwise they do not move
    keyed = ((part, "p_partkey"), (supplier, "s_suppkey"), (nation, "n_nationkey"))
    ties = ["l_extendedprice", "l_shipdate"] if any(_repeats(t, k) for t, k in keyed) else []
    # labels of suppliers are joined where the slots of a paper meet: a supplier table under the session's
    # broadcast threshold goes there, and neither the slots nor the labels are shuffled for it
    country = F.broadcast(nation.select("n_nationkey", F.col("n_name").alias("s_country")))
    settled = supplier.join(country, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    slot = (
        li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *ties)
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .drop("p_partkey").repartition("l_orderkey")
        .join(settled, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .join(country, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("l_orderkey").alias("eid"),
            F.struct("l_linenumber", "l_partkey", "l_suppkey", *ties, "p_name", "p_brand", "s_name", "s_country").alias("s"),
        )
    )
    per_paper = slot.groupBy("eid").agg(F.sort_array(F.collect_list("s")).alias("slots"))

    eid = F.col("eid")
    null_author = (eid % NULL_AUTHOR_MOD) == 0

    def author(x, i):
        pk = x["l_partkey"]
        name = x["p_name"]
        return F.struct(
            F.when(null_author, F.concat(F.lit("x"), pk.cast("string"))).otherwise(pk.cast("string")).alias("auid"),
            (i + 1).cast("int").alias("authorseq"),
            F.when(pk % 50 == 0, F.lit(None).cast("string")).otherwise(name).alias("surname_pn"),
            F.when((eid + pk) % 3 == 0, F.lit(None).cast("string")).otherwise(x["p_brand"]).alias("given_name_pn"),
            F.substring(name, 1, 1).alias("initials_pn"),
            F.when(pk % 100 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(name, F.lit(" "), F.substring(name, 1, 1)))
            .alias("indexed_name_pn"),
            name.alias("indexed_name"),
        )

    # a missing supplier stands last
    found = F.array_distinct("slots.l_suppkey")
    known_sups = F.sort_array(F.array_compact(found))
    sups = F.when(F.size(known_sups) == F.size(found), known_sups).otherwise(F.concat(known_sups, F.array(F.lit(None).cast("long"))))

    def au_af(x, i):
        seq = F.when((eid % BAD_AFFIL_SEQ_MOD) == 0, F.lit(BAD_AFFIL_SEQ)).otherwise(
            F.array_position(F.col("sups"), x["l_suppkey"]).cast("int")
        )
        return F.struct((i + 1).cast("int").alias("authorseq"), seq.cast("int").alias("affiliation_seq"))

    def affiliation(s):
        known = F.when(s % NO_AFFIL_ID_MOD != NO_AFFIL_ID_REST, s)
        # its first slot; a missing supplier has none, which is an error
        first = F.col("slots")[F.coalesce(F.array_position("slots.l_suppkey", s), F.lit(0)).cast("int") - 1]
        org = (
            F.when(s % 13 == 5, F.lit(None).cast("array<string>"))
            .when(s % 11 == 7, F.array().cast("array<string>"))
            .otherwise(F.array(first["s_name"], F.concat(F.lit("Dept "), (eid % 3).cast("string"))))
        )
        return F.struct(
            known.alias("afid"),
            F.array(known).alias("affiliation_ids"),
            org.alias("affiliation_organization"),
            first["s_country"].alias("affiliation_tag_country"),
        )

    nested = per_paper.withColumn("sups", sups).select(
        "eid",
        F.transform("slots", author).alias("au"),
        F.transform("slots", au_af).alias("au_af"),
        F.transform("sups", affiliation).alias("af"),
        F.col("slots")[0]["l_suppkey"].alias("first_supp"),
    )

    # ---- references ----------------------------------------------------------------------
    # offsets reach back a bounded way, so orders are dealt by block of keys, each with those just before
    # it, and the one at an offset is looked up there: no row per offset is shuffled
    block = lambda k: F.floor(k / REFERENCE_BLOCK)
    key, back = F.col("citing"), max(REFERENCE_OFFSETS)
    dealt = orders.filter(F.col("o_orderkey").isNotNull()).select(F.col("o_orderkey").alias("citing"), "o_orderdate").withColumn(
        "block", F.explode(F.array_distinct(F.array(block(key), block(key + back)))))
    near = Window.partitionBy("block").orderBy("citing")
    earlier = [F.when(F.min("o_orderdate").over(near.rangeBetween(-d, -d)) < F.col("o_orderdate"), key - d) for d in REFERENCE_OFFSETS]
    by_offset = (
        dealt.select("citing", "block", F.array(*earlier).alias("cited"))
        .filter(F.col("block") == block(key))
        .select("citing", F.explode("cited").alias("cited"))
        .filter(F.col("cited").isNotNull())
    )
    valid_slot = li.filter((F.col("l_orderkey") % NULL_AUTHOR_MOD) != 0)
    first_of_author = valid_slot.groupBy("l_partkey").agg(F.min("l_orderkey").alias("cited"))
    same_author = (
        valid_slot.filter(F.col("l_partkey") % 3 == 0)
        .join(first_of_author, "l_partkey")
        .filter(F.col("cited") != F.col("l_orderkey"))
        .select(F.col("l_orderkey").alias("citing"), "cited")
    )
    outside = orders.filter(F.col("o_orderkey") % 5 == 0).select(
        F.col("o_orderkey").alias("citing"), (F.col("o_orderkey") + OUTSIDE_ID_BASE).alias("cited")
    )
    # dealt by the citing paper once: duplicates meet there, and its list is made there
    refs = (
        by_offset.unionByName(same_author).unionByName(outside).repartition("citing").distinct()
        .groupBy("citing")
        .agg(F.collect_list("cited").alias("r"))
        # every reference listed twice, as duplicated reference lists occur in the source
        .select(F.col("citing").alias("eid"), F.concat("r", "r").alias("references"))
    )

    # ---- papers ---------------------------------------------------------------------------
    prio = F.substring("o_orderpriority", 1, 1)
    ptype = F.lit(OTHER_TYPE)
    for k, v in reversed(CORE_PRIORITY_TYPES.items()):
        ptype = F.when(prio == k, F.lit(v)).otherwise(ptype)
    corpus = (
        orders.select(
            F.col("o_orderkey").alias("eid"),
            F.year("o_orderdate").cast("int").alias("year"),
            F.col("o_orderdate").alias("datesort"),
            ptype.alias("publication_type"),
        )
        .join(nested, "eid", "left")
        .join(refs, "eid", "left")
        .select(
            "eid", "year", "datesort", "publication_type",
            F.struct(F.col("first_supp").alias("srcid")).alias("source"),
            "references", "au", "au_af", "af",
        )
    )

    tree = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("subfield_code"),
        F.col("n_name").alias("subfield"),
        F.col("n_regionkey").alias("field_code"),
        F.col("r_name").alias("field"),
        F.when(F.col("n_regionkey") < 2, "DOMAIN_A").otherwise("DOMAIN_B").alias("domain"),
    )
    smc = _smc(corpus, supplier, tree)
    discontinued = supplier.filter(F.col("s_suppkey") % 17 == 3).select(F.col("s_suppkey").alias("srcid"))
    journal_map = supplier.filter(F.col("s_suppkey") % 10 != 9).select(
        F.col("s_suppkey").alias("srcid"), F.col("s_nationkey").alias("subfield_code")
    )
    ipr = supplier.filter(F.col("s_suppkey") % 2 == 0).select(
        F.col("s_suppkey").alias("afid"),
        F.concat(F.lit("Institute "), F.col("s_suppkey").cast("string")).alias("preferred_name"),
    )
    inst_map = supplier.select(F.col("s_nationkey").alias("institution_id"), F.col("s_suppkey").alias("afid")).unionByName(
        supplier.filter(F.col("s_suppkey") % 4 == 0).select(
            (F.col("s_nationkey") + 100).alias("institution_id"), F.col("s_suppkey").alias("afid")
        )
    )
    inst = nation.filter(F.col("n_nationkey") % 6 != 0).select(
        F.col("n_nationkey").alias("institution_id"),
        F.concat(F.lit("Inst "), F.col("n_name")).alias("name"),
        F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("country_code"),
    )
    return Inputs(corpus, smc, ipr, discontinued, journal_map, tree, inst_map, inst)
