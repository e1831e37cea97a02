"""Identifier mapping with the parts as the gene table, and cohort preparation steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expression as ex
from ..operators import idmap as im
from ..operators import selection as sel
from ..operators import sets as st
from .registry import query, rounded, table

_DB = """db AS (SELECT p_partkey AS gene_ord, p_name AS symbol, 'ENSG' || lpad(p_partkey::VARCHAR, 11, '0') || '.1' AS ensembl_id,
  p_partkey::VARCHAR AS entrez_id, 'HGNC:' || (p_partkey + 1000000) AS hgnc_id, p_type AS full_name, p_type AS biotype, p_brand AS alias FROM part)"""
_IN = """ids AS (SELECT p_partkey AS pos, CASE p_size % 8 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'ensg' || lpad(p_partkey::VARCHAR, 11, '0') || '.7'
  WHEN 2 THEN ' ' || p_partkey WHEN 3 THEN 'hgnc:' || (p_partkey + 1000000) WHEN 4 THEN lower(p_brand) WHEN 5 THEN 'no ' || p_name
  WHEN 6 THEN (p_partkey + 1000000)::VARCHAR ELSE (p_partkey + 777000000)::VARCHAR END AS id FROM part)"""


def _db(spark, sf):
    key = F.col("p_partkey").cast("string")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("gene_ord"),
        F.col("p_name").alias("symbol"),
        F.concat(F.lit("ENSG"), F.lpad(key, 11, "0"), F.lit(".1")).alias("ensembl_id"),
        key.alias("entrez_id"),
        F.concat(F.lit("HGNC:"), (F.col("p_partkey") + 1000000).cast("string")).alias("hgnc_id"),
        F.col("p_type").alias("full_name"),
        F.col("p_type").alias("biotype"),
        F.array("p_brand").alias("aliases"),
    )


def _ids(spark, sf):
    key = F.col("p_partkey").cast("string")
    kind = F.col("p_size") % 8
    hgnc = (F.col("p_partkey") + 1000000).cast("string")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("pos"),
        F.when(kind == 0, F.upper("p_name"))
        .when(kind == 1, F.concat(F.lit("ensg"), F.lpad(key, 11, "0"), F.lit(".7")))
        .when(kind == 2, F.concat(F.lit(" "), key))
        .when(kind == 3, F.concat(F.lit("hgnc:"), hgnc))
        .when(kind == 4, F.lower("p_brand"))
        .when(kind == 5, F.concat(F.lit("no "), F.col("p_name")))
        .when(kind == 6, hgnc)
        .otherwise((F.col("p_partkey") + 777000000).cast("string"))
        .alias("id"),
    )


_TYPED = f"""{_DB}, {_IN},
ty AS (SELECT pos, trim(id) AS id, CASE WHEN upper(trim(id)) LIKE 'ENS%' THEN 'ensembl' WHEN upper(trim(id)) LIKE 'HGNC:%' THEN 'hgnc'
  WHEN regexp_full_match(trim(id), '[+-]?[0-9]+') THEN CASE WHEN trim(id) IN (SELECT entrez_id FROM db) THEN 'entrez'
    WHEN 'HGNC:' || trim(id) IN (SELECT hgnc_id FROM db) THEN 'hgnc' ELSE 'entrez' END ELSE 'symbol' END AS id_type FROM ids),
mt AS (SELECT DISTINCT pos, gene_ord FROM (
  SELECT pos, gene_ord FROM ty JOIN db ON id_type = 'symbol' AND upper(id) = upper(symbol)
  UNION ALL SELECT pos, gene_ord FROM ty JOIN db ON id_type = 'symbol' AND upper(id) = upper(alias)
  UNION ALL SELECT pos, gene_ord FROM ty JOIN db ON id_type = 'ensembl' AND split_part(upper(id), '.', 1) = split_part(upper(ensembl_id), '.', 1)
  UNION ALL SELECT pos, gene_ord FROM ty JOIN db ON id_type = 'entrez' AND id = entrez_id
  UNION ALL SELECT pos, gene_ord FROM ty JOIN db ON id_type = 'hgnc' AND (CASE WHEN upper(id) LIKE 'HGNC:%' THEN upper(id) ELSE 'HGNC:' || id END) = hgnc_id))"""


@query(
    "id_convert",
    f"""WITH {_TYPED}, rk AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY gene_ord) AS match, count(*) OVER (PARTITION BY pos) AS n FROM mt)
SELECT ty.pos, ty.id AS input, coalesce(match, 1)::INT AS match, CASE WHEN n IS NULL THEN 'Not Found' WHEN match > 1 THEN 'Alt ' || match WHEN n = 1 THEN 'OK'
  ELSE 'Multi (' || n || ')' END AS status, coalesce(match, 1) > 1 AS is_alternate, symbol, ensembl_id, entrez_id, hgnc_id, full_name, biotype
FROM ty LEFT JOIN (SELECT * FROM rk WHERE match <= 5) r ON r.pos = ty.pos LEFT JOIN db ON db.gene_ord = r.gene_ord""",
)
def q_convert(spark, sf):
    return im.convert_ids(_ids(spark, sf), _db(spark, sf))


@query("id_types", f"WITH {_TYPED} SELECT ty.pos, ids.id, id_type FROM ty JOIN ids USING (pos)")
def q_types(spark, sf):
    return im.detect_id_type(_ids(spark, sf), _db(spark, sf))


@query("id_not_found", f"WITH {_TYPED} SELECT pos, ids.id FROM ids WHERE pos NOT IN (SELECT pos FROM mt)")
def q_not_found(spark, sf):
    return im.not_found(_ids(spark, sf), _db(spark, sf))


_SYM = f"""{_TYPED}, sy AS (SELECT ids.pos, ids.id, CASE WHEN ids.id LIKE 'hgnc:%' THEN NULL ELSE (SELECT arg_min(symbol, gene_ord) FROM mt JOIN db USING (gene_ord) WHERE mt.pos = ids.pos) END AS symbol FROM ids)"""


@query("id_to_symbol", f"WITH {_SYM} SELECT * FROM sy")
def q_to_symbol(spark, sf):
    return im.to_symbol(_ids(spark, sf), _db(spark, sf)).select("pos", "id", "symbol")


@query(
    "id_to_ensembl",
    f"""WITH {_TYPED}, f AS (SELECT pos, min(gene_ord) AS gene_ord FROM mt GROUP BY pos)
SELECT ids.pos, ids.id, split_part(ensembl_id, '.', 1) AS ensembl FROM ids LEFT JOIN f USING (pos) LEFT JOIN db USING (gene_ord)""",
)
def q_to_ensembl(spark, sf):
    return im.to_ensembl(_ids(spark, sf), _db(spark, sf)).select("pos", "id", "ensembl")


@query(
    "id_resolve",
    f"""WITH {_TYPED}, f AS (SELECT pos, min(gene_ord) AS gene_ord FROM mt GROUP BY pos)
SELECT ids.pos, CASE WHEN upper(trim(ids.id)) LIKE 'ENSG%' THEN split_part(trim(ids.id), '.', 1) ELSE coalesce(split_part(ensembl_id, '.', 1), trim(ids.id)) END AS resolved
FROM ids LEFT JOIN f USING (pos) LEFT JOIN db USING (gene_ord)""",
)
def q_resolve(spark, sf):
    return im.resolve_for_cohort(_ids(spark, sf), _db(spark, sf)).select("pos", "resolved")


@query(
    "id_report",
    f"""WITH {_SYM}, u AS (SELECT DISTINCT trim(sy.id) AS id, symbol, id_type FROM sy JOIN ty USING (pos))
SELECT count(*) AS total, count(symbol) AS converted, count(*) - count(symbol) AS not_found, round(count(symbol) * 100.0::DOUBLE / count(*), 6) AS success_percent,
  count(*) FILTER (symbol IS NOT NULL AND id_type = 'symbol') AS n_symbol, count(*) FILTER (symbol IS NOT NULL AND id_type = 'ensembl') AS n_ensembl,
  count(*) FILTER (symbol IS NOT NULL AND id_type = 'entrez') AS n_entrez, count(*) FILTER (symbol IS NOT NULL AND id_type = 'hgnc') AS n_hgnc FROM u""",
)
def q_report(spark, sf):
    return rounded(im.conversion_report(_ids(spark, sf), _db(spark, sf)))


@query(
    "gene_lookup",
    """WITH k AS (SELECT p_brand AS project_id, p_partkey AS gene_idx, upper(p_type) AS key, 0 AS kind FROM part UNION ALL SELECT p_brand, p_partkey, upper(p_name), 1 FROM part),
i AS (SELECT project_id, key, min(gene_idx) AS gene_idx FROM k GROUP BY ALL),
q AS (SELECT DISTINCT p_brand AS project_id, p_name || '.3' AS query FROM part UNION SELECT DISTINCT p_brand, lower(p_type) FROM part)
SELECT q.project_id, query, gene_idx FROM q JOIN i ON i.project_id = q.project_id AND key = split_part(upper(query), '.', 1)""",
)
def q_lookup(spark, sf):
    part = table(spark, sf, "part")
    genes = part.select(
        F.col("p_brand").alias("project_id"), F.col("p_partkey").alias("gene_idx"), F.col("p_type").alias("gene_id"), F.col("p_name").alias("gene_name")
    )
    queries = (
        part.select(F.col("p_brand").alias("project_id"), F.concat("p_name", F.lit(".3")).alias("query"))
        .union(part.select("p_brand", F.lower("p_type")))
        .distinct()
    )
    return im.resolve_genes(queries, genes)


@query(
    "fill_names",
    f"""WITH {_DB}, g AS (SELECT p_partkey, 'ENSG' || lpad(CASE WHEN p_size % 2 = 0 THEN p_partkey ELSE p_partkey + 777000000 END::VARCHAR, 11, '0') AS gene_id,
  CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'ENSG1' ELSE p_name END AS gene_name FROM part)
SELECT p_partkey, gene_id, CASE WHEN gene_name = '' OR gene_name LIKE 'ENSG%' THEN coalesce(symbol, gene_id) ELSE gene_name END AS gene_name
FROM g LEFT JOIN db ON gene_id = split_part(ensembl_id, '.', 1)""",
)
def q_fill_names(spark, sf):
    g = table(spark, sf, "part").select(
        "p_partkey",
        F.concat(
            F.lit("ENSG"),
            F.lpad(F.when(F.col("p_size") % 2 == 0, F.col("p_partkey")).otherwise(F.col("p_partkey") + 777000000).cast("string"), 11, "0"),
        ).alias("gene_id"),
        F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "ENSG1").otherwise(F.col("p_name")).alias("gene_name"),
    )
    return im.fill_names(g, _db(spark, sf)).select("p_partkey", "gene_id", "gene_name")


@query(
    "id_cleanups",
    """SELECT p_partkey, split_part(p_name || '.' || p_size, '.', 1) AS clean, array_to_string(string_split(replace(p_name, ' ', '-') || '-' || p_type || '-' || p_size, '-')[1:3], '-') AS patient,
CASE WHEN p_type = 'STANDARD' THEN 'Normal' ELSE 'Tumor' END AS condition FROM part""",
)
def q_cleanups(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        im.strip_version(F.concat("p_name", F.lit("."), F.col("p_size"))).alias("clean"),
        im.patient_id(F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), "p_type", F.col("p_size").cast("string"))).alias("patient"),
        im.condition_of(F.when(F.col("p_type") == "STANDARD", "Solid Tissue Normal").otherwise("Primary Tumor")).alias("condition"),
    )


# ---------------------------------------------------------------- cohort steps, sets and ordering


def _samples(spark, sf):
    """Orders as cohort samples: project = priority, condition by price, status and days from the order."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderpriority").alias("project_id"),
        F.col("o_orderkey").alias("sample_idx"),
        F.concat_ws("-", F.lit("TS"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.lit("01A")).alias("sample_id"),
        F.when(F.col("o_totalprice") > 100000, "Tumor").otherwise("Normal").alias("condition"),
        F.when(F.col("o_orderstatus") == "F", "Dead").when(F.col("o_orderstatus") == "O", "Alive").otherwise("").alias("vital_status"),
        F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("days_to_death"),
        F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate")).alias("days_to_last_follow_up"),
    )


_SMP = """smp AS (SELECT o_orderpriority AS project_id, o_orderkey AS sample_idx, CASE WHEN o_totalprice > 100000 THEN 'Tumor' ELSE 'Normal' END AS condition,
  CASE o_orderstatus WHEN 'F' THEN 'Dead' WHEN 'O' THEN 'Alive' ELSE '' END AS vital_status, datediff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS dd,
  datediff('day', o_orderdate::DATE, DATE '2002-01-01')::INT AS df FROM orders)"""


@query(
    "survival_frame",
    f"""WITH {_SMP} SELECT project_id, sample_idx, CASE WHEN vital_status = 'Dead' THEN dd ELSE df END AS time, vital_status = 'Dead' AS event FROM smp
WHERE condition = 'Tumor' AND vital_status <> '' AND CASE WHEN vital_status = 'Dead' THEN dd ELSE df END > 0""",
)
def q_survival_frame(spark, sf):
    from ..operators.survival import survival_frame

    return survival_frame(_samples(spark, sf)).select("project_id", "sample_idx", "time", "event")


@query(
    "survival_available",
    f"WITH {_SMP} SELECT project_id, count(*) FILTER (vital_status <> '') AS n_status FROM smp GROUP BY project_id HAVING count(*) FILTER (vital_status <> '') > 10",
)
def q_survival_available(spark, sf):
    from ..operators.survival import survival_available

    return survival_available(_samples(spark, sf), "project_id")


@query(
    "cohort_index",
    f"""WITH {_SMP}, g AS (SELECT o_orderpriority AS project_id, count(DISTINCT l_partkey) AS n_genes FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT project_id, n_genes, count(*) AS n_samples, count(*) FILTER (condition = 'Tumor') AS n_tumor, count(*) FILTER (condition = 'Normal') AS n_normal,
  count(df) AS n_survival_available, count(*) FILTER (vital_status = 'Alive') AS n_alive, count(*) FILTER (vital_status = 'Dead') AS n_dead
FROM smp JOIN g USING (project_id) GROUP BY project_id, n_genes""",
)
def q_cohort_index(spark, sf):
    from ..operators.cohort import cohort_index

    genes = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_orderpriority").alias("project_id"), F.col("l_partkey").alias("gene_idx"))
        .distinct()
    )
    return cohort_index(_samples(spark, sf), genes)


@query(
    "fact_with_samples",
    f"""WITH {_SMP} SELECT project_id, sample_idx, l_partkey AS gene_idx, round(log2(l_quantity + 1), 6) AS value, condition
FROM lineitem JOIN smp ON l_orderkey = sample_idx""",
)
def q_with_samples(spark, sf):
    s = _samples(spark, sf)
    fact = (
        table(spark, sf, "lineitem")
        .join(s.select("project_id", F.col("sample_idx").alias("_k")), F.col("l_orderkey") == F.col("_k"))
        .select("project_id", F.col("l_orderkey").alias("sample_idx"), F.col("l_partkey").alias("gene_idx"), F.round(ex.log2p1("l_quantity"), 6).alias("value"))
    )
    return ex.with_samples(fact, s.select("project_id", "sample_idx", "condition"))


@query("by_condition", f"WITH {_SMP} SELECT project_id, sample_idx, condition FROM smp WHERE condition = 'Normal'")
def q_by_condition(spark, sf):
    return ex.by_condition(_samples(spark, sf), "Normal").select("project_id", "sample_idx", "condition")


@query(
    "both_conditions",
    f"WITH {_SMP} SELECT project_id, sample_idx, condition, CASE WHEN condition = 'Tumor' THEN 0 ELSE 1 END AS condition_order FROM smp",
)
def q_both(spark, sf):
    return ex.both_conditions(_samples(spark, sf)).select("project_id", "sample_idx", "condition", "condition_order")


@query(
    "join_clinical",
    """WITH c AS (SELECT 'TS-' || c_custkey || '-' || o_orderkey AS patient_id, c_mktsegment AS gender, row_number() OVER (PARTITION BY c_custkey, o_orderkey ORDER BY c_name) AS rn
  FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0)
SELECT 'TS-' || o_custkey || '-' || o_orderkey || '-01A' AS sample_id, 'TS-' || o_custkey || '-' || o_orderkey AS patient_id, gender
FROM orders LEFT JOIN c ON c.patient_id = 'TS-' || o_custkey || '-' || o_orderkey AND rn = 1""",
)
def q_join_clinical(spark, sf):
    from ..operators.cohort import join_clinical

    o = table(spark, sf, "orders")
    clinical = (
        table(spark, sf, "customer")
        .where(F.col("c_acctbal") > 0)
        .join(o, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.concat_ws("-", F.lit("TS"), F.col("c_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("patient_id"),
            F.col("c_mktsegment").alias("gender"),
            F.col("c_name").alias("row_order"),
        )
    )
    return join_clinical(_samples(spark, sf).select("sample_id"), clinical, "row_order").select("sample_id", "patient_id", "gender")


@query("common_samples", "SELECT l_orderkey AS sample, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def q_common(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample"), "l_linenumber", "l_quantity")
    return st.common_samples(li, table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("sample")))


@query(
    "merge_libraries",
    """WITH u AS (SELECT lower(p_name) AS k, p_name AS name, 'part' AS category, 0 AS src FROM part UNION ALL SELECT lower(p_type), p_type, 'type', 1 FROM part
UNION ALL SELECT lower(upper(p_name)), upper(p_name), 'copy', 2 FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src, name) AS rn FROM u) SELECT name, category FROM r WHERE rn = 1""",
)
def q_merge_libraries(spark, sf):
    p = table(spark, sf, "part")
    lib = lambda c, n: p.select(c.alias("name"), F.lit(n).alias("category"))
    return st.merge_libraries(lib(F.col("p_name"), "part"), lib(F.col("p_type"), "type"), lib(F.upper("p_name"), "copy"))


@query("vectors_by", "SELECT p_partkey, p_name AS name, p_brand AS category FROM part WHERE p_brand = 'Brand#7'")
def q_vectors_by(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("category"))
    return st.vectors_by(p, category="BRAND#7")


@query("categories", "SELECT DISTINCT p_brand AS category FROM part")
def q_categories(spark, sf):
    return st.categories(table(spark, sf, "part").select(F.col("p_brand").alias("category")))


@query(
    "top_k",
    """SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 20""",
)
def q_top_k(spark, sf):
    li = table(spark, sf, "lineitem")
    return sel.top_k(li, "l_returnflag", [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], 20).select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", "rank"
    )


@query(
    "first_k",
    """SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) WHERE rn <= 4""",
)
def q_first_k(spark, sf):
    return sel.first_k(table(spark, sf, "events"), "event_type", "event_id", 4).select("event_type", "event_id")


@query("sort_two", "SELECT p_partkey, p_size, p_retailprice FROM part")
def q_sort_two(spark, sf):
    return sel.sort_two(table(spark, sf, "part"), F.desc("p_size"), F.asc("p_retailprice"), "p_partkey").select(
        "p_partkey", "p_size", "p_retailprice"
    )


@query(
    "sort_numeric",
    """SELECT p_partkey, x FROM (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name ELSE p_size::VARCHAR END AS x FROM part) WHERE try_cast(x AS DOUBLE) IS NOT NULL""",
)
def q_sort_numeric(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") % 4 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string")).alias("x")
    )
    return sel.sort_numeric(p, "x", True, "p_partkey")


@query("natural_sort", "SELECT p_brand || ' ' || p_name AS label, p_partkey AS accession FROM part")
def q_natural(spark, sf):
    p = table(spark, sf, "part").select(F.concat_ws(" ", "p_brand", "p_name").alias("label"), F.col("p_partkey").alias("accession"))
    return sel.natural_sort(p, "label", "accession")
