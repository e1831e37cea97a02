"""Identifier mapping between symbols (with aliases), Ensembl, Entrez and HGNC ids.

The gene table is unpivoted once into (id_type, key, gene_ord); every lookup is an equi-join on it. Inputs are
made distinct before the join, so a much repeated id costs one probe. Nothing is hinted: Spark broadcasts the
key table when it is small enough and sort-merges otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import top_k

GENE_COLUMNS = ["symbol", "ensembl_id", "entrez_id", "hgnc_id", "full_name", "biotype"]
_HGNC = "HGNC:"


def _strip_version(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def strip_version(c: Column | str) -> Column:
    return _strip_version(F.col(c) if isinstance(c, str) else c)


def id_keys(gene_db: DataFrame) -> DataFrame:
    """(id_type, key, gene_ord) of every identifier, keys in comparison form.

    A symbol key (symbol or alias, any case) lists all its genes; of several genes with one Ensembl, Entrez or
    HGNC key the last in table order counts. HGNC ids are known with and without their prefix.
    """
    some = lambda c: F.when(F.length(c) > 0, F.array(F.col(c))).otherwise(F.array())
    names = F.concat(
        some("symbol"), F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.length(a) > 0)
    )
    symbols = gene_db.select(
        F.lit("symbol").alias("id_type"), F.explode(F.array_distinct(F.transform(names, lambda a: F.upper(a)))).alias("key"), "gene_ord"
    )
    pair = lambda t, k: F.struct(F.lit(t).alias("id_type"), k.alias("key"))
    hgnc = F.upper("hgnc_id")
    singles = F.array(
        pair("ensembl", F.upper(_strip_version(F.col("ensembl_id")))),
        pair("entrez", F.col("entrez_id")),
        pair("hgnc", hgnc),
        pair("hgnc", F.when(F.startswith("hgnc_id", F.lit(_HGNC)), F.substr(hgnc, F.lit(len(_HGNC) + 1)))),
    )
    last = (
        gene_db.select("gene_ord", F.inline(singles))
        .where(F.length("key") > 0)
        .groupBy("id_type", "key")
        .agg(F.max("gene_ord").alias("gene_ord"))
    )
    return symbols.unionByName(last.select("id_type", "key", "gene_ord"))


def _is_integer(c: Column) -> Column:
    return F.coalesce(c.rlike("^[+-]?[0-9]+$") & c.try_cast("int").isNotNull(), F.lit(False))


def _candidate(kind: str, key: Column, priority: int) -> Column:
    return F.struct(F.lit(kind).alias("id_type"), key.alias("key"), F.lit(priority).alias("priority"))


def _unique_ids(ids: DataFrame, id_col: str) -> DataFrame:
    return ids.select(F.trim(id_col).alias("_id")).where(F.length("_id") > 0).distinct()


def detect_id_type(ids: DataFrame, gene_db: DataFrame, id_col: str = "id") -> DataFrame:
    """Add ``id_type``: by prefix ENS or HGNC:, whole numbers as known Entrez, else known HGNC, else Entrez;
    other text is a symbol, blank is unknown."""
    kinds = _detected(_unique_ids(ids, id_col), id_keys(gene_db))
    return (
        ids.withColumn("_id", F.trim(id_col))
        .join(kinds, "_id", "left")
        .withColumn("id_type", F.coalesce("id_type", F.lit("unknown")))
        .drop("_id")
    )


def _detected(unique: DataFrame, keys: DataFrame) -> DataFrame:
    upper = F.upper("_id")
    number = _is_integer(F.col("_id"))
    probes = unique.select(
        "_id",
        F.explode(
            F.array(_candidate("entrez", F.when(number, F.col("_id")), 0), _candidate("hgnc", F.when(number, F.concat(F.lit(_HGNC), upper)), 1))
        ).alias("_c"),
    ).select("_id", "_c.*")
    known = (
        probes.join(keys.select("id_type", "key").distinct().withColumn("_hit", F.lit(True)), ["id_type", "key"], "left")
        .groupBy("_id")
        .agg(
            F.max(F.when(F.col("id_type") == "entrez", F.col("_hit"))).alias("_entrez"),
            F.max(F.when(F.col("id_type") == "hgnc", F.col("_hit"))).alias("_hgnc"),
        )
    )
    return known.select(
        "_id",
        F.when(F.startswith(upper, F.lit("ENS")), "ensembl")
        .when(F.startswith(upper, F.lit(_HGNC)), "hgnc")
        .when(number, F.when(F.col("_entrez"), "entrez").when(F.col("_hgnc"), "hgnc").otherwise("entrez"))
        .otherwise("symbol")
        .alias("id_type"),
    )


def _matches(unique_typed: DataFrame, keys: DataFrame) -> DataFrame:
    """(_id, gene_ord) of every match of a typed id; an HGNC id is tried as given, then with the prefix."""
    upper = F.upper("_id")
    key = (
        F.when(F.col("id_type") == "ensembl", _strip_version(upper))
        .when(F.col("id_type") == "entrez", F.col("_id"))
        .otherwise(upper)
    )
    probes = unique_typed.select(
        "_id",
        F.explode(
            F.when(
                F.col("id_type") == "hgnc",
                F.array(
                    F.struct("id_type", key.alias("key"), F.lit(0).alias("priority")),
                    F.struct("id_type", F.concat(F.lit(_HGNC), upper).alias("key"), F.lit(1).alias("priority")),
                ),
            ).otherwise(F.array(F.struct("id_type", key.alias("key"), F.lit(0).alias("priority"))))
        ).alias("_c"),
    ).select("_id", "_c.*")
    found = probes.join(keys, ["id_type", "key"])
    # Only HGNC probes have two priorities; both name at most one gene, so the better one is kept.
    hgnc = found.where(F.col("id_type") == "hgnc").groupBy("_id").agg(F.min_by("gene_ord", "priority").alias("gene_ord"))
    return found.where(F.col("id_type") != "hgnc").select("_id", "gene_ord").unionByName(hgnc)


def convert_ids(
    ids: DataFrame, gene_db: DataFrame, id_type: str = "auto", max_alt: int = 4, id_col: str = "id", pos_col: str = "pos"
) -> DataFrame:
    """Conversion table: ``OK``, ``Not Found`` or ``Multi (n)`` with up to ``max_alt`` rows ``Alt k``.

    The first match in gene-table order is the main row; ``is_alternate`` marks the others.
    """
    keys = id_keys(gene_db)
    unique = _unique_ids(ids, id_col)
    typed = _detected(unique, keys) if id_type == "auto" else unique.withColumn("id_type", F.lit(id_type))
    matches = _matches(typed, keys)
    counts = matches.groupBy("_id").agg(F.count(F.lit(1)).alias("n_matches"))
    first = top_k(matches, "_id", "gene_ord", max_alt + 1, "match")
    resolved = first.join(counts, "_id").join(gene_db.select("gene_ord", *GENE_COLUMNS), "gene_ord").drop("gene_ord")
    out = ids.withColumn("_id", F.trim(id_col)).where(F.length("_id") > 0).join(resolved, "_id", "left")
    status = (
        F.when(F.col("n_matches").isNull(), "Not Found")
        .when(F.col("match") > 1, F.concat(F.lit("Alt "), F.col("match").cast("string")))
        .when(F.col("n_matches") == 1, "OK")
        .otherwise(F.concat(F.lit("Multi ("), F.col("n_matches").cast("string"), F.lit(")")))
    )
    return out.select(
        pos_col,
        F.col("_id").alias("input"),
        F.coalesce("match", F.lit(1)).alias("match"),
        status.alias("status"),
        (F.coalesce("match", F.lit(1)) > 1).alias("is_alternate"),
        *GENE_COLUMNS,
    )


def not_found(ids: DataFrame, gene_db: DataFrame, id_type: str = "auto", id_col: str = "id") -> DataFrame:
    """Input rows without a match."""
    keys = id_keys(gene_db)
    unique = _unique_ids(ids, id_col)
    typed = _detected(unique, keys) if id_type == "auto" else unique.withColumn("id_type", F.lit(id_type))
    hits = _matches(typed, keys).select("_id").distinct()
    return (
        ids.withColumn("_id", F.trim(id_col)).where(F.length("_id") > 0).join(hits, "_id", "left_anti").drop("_id")
    )


def _symbols_of(unique: DataFrame, gene_db: DataFrame) -> DataFrame:
    """(_id, symbol): symbol or alias first, then Ensembl, HGNC, Entrez."""
    upper, raw = F.upper("_id"), F.col("_id")
    number = _is_integer(raw)
    as_hgnc = F.when(F.startswith(raw, F.lit(_HGNC)), upper).otherwise(F.concat(F.lit(_HGNC), upper))
    probes = unique.select(
        "_id",
        F.explode(
            F.array(
                _candidate("symbol", upper, 0),
                _candidate("ensembl", F.when(F.startswith(upper, F.lit("ENS")), _strip_version(upper)), 1),
                _candidate("hgnc", F.when(number | F.startswith(upper, F.lit(_HGNC)), as_hgnc), 2),
                _candidate("entrez", F.when(number, raw), 3),
            )
        ).alias("_c"),
    ).select("_id", "_c.*")
    best = (
        probes.where(F.col("key").isNotNull())
        .join(id_keys(gene_db), ["id_type", "key"])
        .groupBy("_id")
        .agg(F.min(F.struct("priority", "gene_ord")).alias("_b"))
    )
    return best.select("_id", F.col("_b.gene_ord").alias("gene_ord")).join(
        gene_db.select("gene_ord", "symbol"), "gene_ord"
    ).select("_id", "symbol")


def to_symbol(ids: DataFrame, gene_db: DataFrame, id_col: str = "id") -> DataFrame:
    """Add ``symbol`` for any kind of id; NULL when unknown."""
    return (
        ids.withColumn("_id", F.trim(id_col)).join(_symbols_of(_unique_ids(ids, id_col), gene_db), "_id", "left").drop("_id")
    )


def to_ensembl(ids: DataFrame, gene_db: DataFrame, id_col: str = "id") -> DataFrame:
    """Add ``ensembl``: version-free Ensembl id of the first match of the detected type; NULL when unknown."""
    keys = id_keys(gene_db)
    first = _matches(_detected(_unique_ids(ids, id_col), keys), keys).groupBy("_id").agg(F.min("gene_ord").alias("gene_ord"))
    named = first.join(gene_db.select("gene_ord", "ensembl_id"), "gene_ord").select(
        "_id", F.when(F.length("ensembl_id") > 0, _strip_version(F.col("ensembl_id"))).alias("ensembl")
    )
    return ids.withColumn("_id", F.trim(id_col)).join(named, "_id", "left").drop("_id")


def resolve_for_cohort(ids: DataFrame, gene_db: DataFrame, id_col: str = "id") -> DataFrame:
    """Add ``resolved``: ENSG ids lose their version, other ids become their Ensembl id or stay as they are."""
    raw = F.trim(id_col)
    return to_ensembl(ids, gene_db, id_col).withColumn(
        "resolved",
        F.when(F.startswith(F.upper(raw), F.lit("ENSG")), _strip_version(raw)).otherwise(F.coalesce("ensembl", raw)),
    ).drop("ensembl")


def conversion_report(ids: DataFrame, gene_db: DataFrame, id_col: str = "id") -> DataFrame:
    """One row over the distinct ids: total, converted, not found, success percent and converted ids by type."""
    unique = _unique_ids(ids, id_col)
    typed = _detected(unique, id_keys(gene_db)).join(_symbols_of(unique, gene_db), "_id", "left")
    ok = F.col("symbol").isNotNull()
    return typed.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("converted"),
        F.count_if(~ok).alias("not_found"),
        (F.count_if(ok) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("success_percent"),
        *[
            F.count_if(ok & (F.col("id_type") == t)).alias(f"n_{t}")
            for t in ("symbol", "ensembl", "entrez", "hgnc")
        ],
    )


def resolve_genes(queries: DataFrame, genes: DataFrame, query_col: str = "query") -> DataFrame:
    """Gene lookup inside a cohort: adds ``gene_idx`` per (project, query).

    The index holds ids without version and then names, any case, the first entry winning; a query is tried
    without its version first, then as given.
    """
    entries = genes.select(
        "project_id",
        "gene_idx",
        F.inline(
            F.array(
                F.struct(F.upper(_strip_version(F.col("gene_id"))).alias("key"), F.lit(0).alias("_kind")),
                F.struct(F.upper("gene_name").alias("key"), F.lit(1).alias("_kind")),
            )
        ),
    ).where(F.length("key") > 0)
    # The index is filled gene by gene, id before name, and keeps the first entry of a key.
    index = entries.groupBy("project_id", "key").agg(F.min(F.struct("gene_idx", "_kind")).alias("_e")).select(
        "project_id", "key", F.col("_e.gene_idx").alias("gene_idx")
    )
    probes = queries.select(
        "project_id",
        query_col,
        F.inline(
            F.array(
                F.struct(_strip_version(F.upper(query_col)).alias("key"), F.lit(0).alias("_try")),
                F.struct(F.upper(query_col).alias("key"), F.lit(1).alias("_try")),
            )
        ),
    )
    return (
        probes.join(index, ["project_id", "key"])
        .groupBy("project_id", query_col)
        .agg(F.min_by("gene_idx", "_try").alias("gene_idx"))
    )


def fill_names(df: DataFrame, gene_db: DataFrame, id_col: str = "gene_id", name_col: str = "gene_name") -> DataFrame:
    """Empty names (and names that are ENSG ids) become the symbol of the id, else the id itself."""
    empty = F.coalesce(F.col(name_col), F.lit("")) == ""
    blank = empty | F.startswith(F.coalesce(F.col(name_col), F.lit("")), F.lit("ENSG"))
    known = to_symbol(df, gene_db, id_col)
    return known.withColumn(name_col, F.when(blank, F.coalesce("symbol", id_col)).otherwise(F.col(name_col))).drop("symbol")


def patient_id(sample: Column | str) -> Column:
    """First three dash-separated parts of a sample barcode."""
    return F.substring_index(sample, "-", 3)


def condition_of(sample_type: Column | str) -> Column:
    """Normal for solid normal tissue, Tumor for every other sample type."""
    c = F.col(sample_type) if isinstance(sample_type, str) else sample_type
    return F.when(c == "Solid Tissue Normal", "Normal").otherwise("Tumor")
