"""Gene tables: JSON database, HGNC and NCBI imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = ["symbol", "ensembl_id", "entrez_id", "hgnc_id", "full_name", "biotype", "chromosome", "mgi_id", "rgd_id", "zfin_id"]


def _keyed(text: Column, kind: str) -> Column:
    """JSON object(s) as maps from lower-case key to value; nested values stay JSON text."""
    lower = lambda m: F.transform_keys(m, lambda k, _: F.lower(k))
    parsed = F.from_json(text, kind)
    return F.transform(parsed, lower) if kind.startswith("ARRAY") else lower(parsed)


def read_gene_db(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON ``{info, genes[]}`` (keys in any case) -> (genes with gene_ord, one-row header). Values are not changed."""
    doc = spark.read.text(path, wholetext=True).select(_keyed(F.col("value"), "MAP<STRING, STRING>").alias("d"))
    genes = doc.select(F.posexplode(_keyed(F.col("d")["genes"], "ARRAY<MAP<STRING, STRING>>")).alias("gene_ord", "g"))
    out = genes.select(
        "gene_ord",
        *[F.col("g")[c.replace("_", "")].alias(c) for c in _FIELDS],
        F.from_json(F.col("g")["aliases"], "ARRAY<STRING>").alias("aliases"),
    )
    info = doc.select(_keyed(F.col("d")["info"], "MAP<STRING, STRING>").alias("i"))
    return out, info.select(
        F.col("i")["species"].alias("species"),
        F.col("i")["version"].alias("version"),
        F.col("i")["genecount"].cast("int").alias("gene_count"),
        F.col("i")["lastupdate"].try_cast("timestamp").alias("last_update"),
        F.col("i")["sources"].alias("sources"),
    )


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def _field(df: DataFrame, name: str, dash_is_null: bool = False) -> Column:
    """Trimmed field without surrounding quotes, NULL when empty or absent; header names in any case."""
    actual = {c.strip().lstrip("#").lower(): c for c in df.columns}.get(name.lower())
    if actual is None:
        return F.lit(None).cast("string")
    v = F.regexp_replace(F.trim(F.col(f"`{actual}`")), '^"+|"+$', "")
    empty = (v == "") | (v == "-") if dash_is_null else v == ""
    return F.when(~empty, v)


def _names(*columns: Column) -> Column:
    """Pipe-separated lists -> distinct trimmed names, NULL when there is none."""
    lists = [F.coalesce(F.split(c, r"\|"), F.array().cast("array<string>")) for c in columns]
    clean = F.filter(F.transform(F.concat(*lists), lambda a: F.trim(a)), lambda a: a != "")
    return F.nullif(F.array_distinct(clean), F.array().cast("array<string>"))


def import_hgnc(spark: SparkSession, path: str) -> DataFrame:
    """HGNC table; aliases are the alias and previous symbols. Rows without symbol are dropped."""
    df = _tsv(spark, path)
    f = lambda n: _field(df, n)
    return df.select(
        F.monotonically_increasing_id().alias("gene_ord"),
        f("symbol").alias("symbol"),
        f("ensembl_gene_id").alias("ensembl_id"),
        f("entrez_id").alias("entrez_id"),
        f("hgnc_id").alias("hgnc_id"),
        f("name").alias("full_name"),
        f("locus_type").alias("biotype"),
        f("location").alias("chromosome"),
        _names(f("alias_symbol"), f("prev_symbol")).alias("aliases"),
    ).where(F.col("symbol").isNotNull())


def import_gene_info(spark: SparkSession, path: str, ensembl_prefix: str) -> DataFrame:
    """NCBI gene_info (plain or gzip); ``-`` is NULL, the Ensembl id comes out of dbXrefs."""
    df = _tsv(spark, path)
    f = lambda n: _field(df, n)
    d = lambda n: _field(df, n, True)
    found = F.regexp_extract(F.coalesce(d("dbXrefs"), F.lit("")), f"Ensembl:({ensembl_prefix}[0-9]+)", 1)
    return df.select(
        F.monotonically_increasing_id().alias("gene_ord"),
        d("Symbol").alias("symbol"),
        F.when(found != "", found).alias("ensembl_id"),
        f("GeneID").alias("entrez_id"),
        F.lit(None).cast("string").alias("hgnc_id"),
        d("description").alias("full_name"),
        d("type_of_gene").alias("biotype"),
        d("chromosome").alias("chromosome"),
        _names(d("Synonyms")).alias("aliases"),
    ).where(F.col("symbol").isNotNull())
