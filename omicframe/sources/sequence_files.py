"""FASTA, enzyme lists and GenBank records."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import ascii_upper
from ..operators.selection import natural_sort_keys, top_k


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence) per record; only A, C, G, T kept, upper-cased.

    A record starts at a line that begins with ``>``; the rest of that line is its name, other ``>`` in it included.
    Text before the first such line, or a file without one, is a record with an empty name (if it has any base).
    """
    parts = spark.read.option("lineSep", "\n>").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task reads a split from its begin to its end, so a file's first row is the first one of its split at 0.
        last = None
        for b in batches:
            leading = []
            for place in zip(b.column("file").to_pylist(), b.column("block").to_pylist()):
                leading.append(place[1] == 0 and place != last)
                last = place
            yield pa.RecordBatch.from_arrays([b.column("value"), pa.array(leading, pa.bool_())], ["value", "leading"])

    records = parts.mapInArrow(marked, "value string, leading boolean")
    named = ~F.col("leading") | F.startswith("value", F.lit(">"))
    text = F.when(F.col("leading") & named, F.substr("value", F.lit(2))).otherwise(F.col("value"))
    body = F.when(named, F.regexp_replace(text, r"^[^\r\n]*", "")).otherwise(text)
    return (
        records.select(
            F.when(named, F.trim(F.regexp_extract(text, r"^([^\r\n]*)", 1))).otherwise(F.lit("")).alias("name"),
            F.regexp_replace(ascii_upper(body), "[^ACGT]", "").alias("sequence"),
            named.alias("named"),
        )
        .where("named or sequence <> ''")
        .drop("named")
    )


def read_enzymes(spark: SparkSession, path: str) -> DataFrame:
    """``Name;Site;cut5;cut3`` lines -> (name, site, cut5, cut3) by name; comments and bad lines skipped.

    Of several entries with one name (any case) the first wins.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_line"))
    parts = F.split("value", ";")
    parsed = (
        lines.where(~F.rlike("value", F.lit(r"^\s*(#|$)")))
        .where(F.size(parts) >= 4)
        .select(
            "_line",
            F.trim(parts[0]).alias("name"),
            F.upper(F.trim(parts[1])).alias("site"),
            F.trim(parts[2]).try_cast("int").alias("cut5"),
            F.trim(parts[3]).try_cast("int").alias("cut3"),
        )
        .where(F.col("cut5").isNotNull() & F.col("cut3").isNotNull())
        .withColumn("_key", F.lower("name"))
    )
    return top_k(parsed, "_key", "_line", 1, "_rn").drop("_rn", "_key", "_line").orderBy("name")


# Keywords that decide a feature's type and a vector's category.
RESISTANCE = [
    "ampr", "amp(r)", "bla", "beta-lactamase", "ampicillin", "kanr", "kan(r)", "kanamycin", "aph(3", "nptii", "neor",
    "neo(r)", "neomycin", "cmr", "cat", "chloramphenicol", "tetr", "tet(r)", "tetracycline", "genr", "gentamicin",
    "hygr", "hygromycin", "zeor", "zeocin", "bler", "puror", "puromycin", "pac", "specr", "spectinomycin", "aada",
    "blasticidin", "bsr", "nourseothricin", "nat", "resistance",
]
REPORTER = [
    "gfp", "egfp", "eyfp", "ecfp", "mcherry", "rfp", "dsred", "tdtomato", "venus", "cerulean", "citrine",
    "luciferase", "luc2", "fluc", "firefly", "renilla", "rluc", "nanoluc", "nluc", "lacz", "beta-gal", "β-gal",
    "seap", "reporter",
]
TAG = [
    "his-tag", "his tag", "6xhis", "his6", "histag", "polyhistidine", "flag", "ha-tag", "ha tag", "myc-tag", "myc tag",
    "c-myc", "v5-tag", "v5 tag", "gst", "glutathione", "mbp", "maltose", "strep-tag", "strep tag", "sumo", "thioredoxin",
    "trx", "thrombin", "tev site", "prescission", "linker",
]
KEY_TYPES = {
    "promoter": "Promoter", "caat_signal": "Promoter", "tata_signal": "Promoter", "terminator": "Terminator",
    "rep_origin": "Origin", "polya_signal": "PolyA", "polya_site": "PolyA", "enhancer": "Enhancer", "primer_bind": "Misc",
}
NAME_TYPES = [
    ("Promoter", ["promoter", "prm"]),
    ("Terminator", ["terminator", "term "]),
    ("PolyA", ["polya", "poly(a)", "poly a"]),
    ("Enhancer", ["enhancer"]),
    ("MCS", ["mcs", "multiple cloning", "polylinker"]),
]
ORIGINS = ["cole1", "f1", "pmb1", "p15a", "sv40", "puc"]
CATEGORIES = [
    ("Lentiviral", ["ltr", "psi", "wpre"], ["plko", "plenti", "pcdh"], []),
    ("Mammalian Expression", ["cmv", "ef1", "cag", "sv40", "bgh"], [], []),
    ("Luciferase Reporter", ["luciferase", "luc2"], ["pgl", "prl", "pnl"], []),
    ("E. coli Expression", [], ["pet", "pgex", "pmal", "pcold"], []),
    ("TA / TOPO Cloning", [], ["pgem", "pcr2", "pcr-blunt", "topo", "pjet", "pta"], []),
    ("E. coli Cloning", [], ["puc", "pbr", "pbluescript"], []),
    ("Packaging", [], ["pmd2", "pspax", "pax2"], ["packaging", "envelope"]),
]


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) with plain line ends; one record per file."""
    return spark.read.text(path, wholetext=True).select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"),
        F.regexp_replace("value", "\r\n?", "\n").alias("text"),
    )


def _features_text() -> Column:
    """Lines of the FEATURES section."""
    return F.regexp_extract("text", r"(?s)(?:^|\n)FEATURES[^\n]*\n(.*?)(?:\n[A-Za-z]|$)", 1)


def _blocks(records: DataFrame) -> DataFrame:
    """(file, feature_no, key, location, quals): one row per feature; quals are ``/name=value`` texts on one line."""
    # A feature starts at a line with 1 to 10 blanks, a key, a blank and its location.
    marked = F.regexp_replace(_features_text(), r"(?m)^( {1,10})(?=[A-Za-z][A-Za-z0-9_']{0,18} )", "\u0001")
    block = records.select("file", F.posexplode(F.split(marked, "\u0001")).alias("feature_no", "_b")).where("feature_no > 0")
    lines = F.transform(F.split("_b", "\n"), lambda v: F.trim(v))
    first_qual = F.array_position(F.transform("_l", lambda v: F.startswith(v, F.lit("/"))), True)
    location = F.when(first_qual > 0, F.slice("_l", F.lit(1), (first_qual - 1).cast("int"))).otherwise(F.col("_l"))
    quals = F.when(first_qual > 0, F.slice("_l", first_qual.cast("int"), F.size("_l"))).otherwise(F.array().cast("array<string>"))
    return (
        block.withColumn("_l", F.filter(lines, lambda v: v != ""))
        .withColumn("_loc", F.array_join(location, ""))
        .select(
            "file",
            "feature_no",
            F.regexp_extract("_loc", r"^(\S+)", 1).alias("key"),
            F.regexp_replace(F.regexp_replace("_loc", r"^\S+", ""), r"\s+", "").alias("location"),
            # Qualifiers are joined and cut at the slash that opens the next one.
            F.split(F.array_join(quals, " "), r" (?=/[A-Za-z_]+(?:=| |$))").alias("quals"),
        )
    )


def _qualifier(name: str) -> Column:
    """Value of a qualifier: the last one for ``label``, the first one otherwise; NULL when blank."""
    hits = F.filter("quals", lambda q: F.rlike(q, F.lit(rf"(?i)^/{name}=")))
    one = F.try_element_at(hits, F.lit(-1 if name == "label" else 1))
    value = F.regexp_replace(F.trim(F.regexp_replace(one, r"^/[^=]*=", "")), '^"+|"+$', "")
    return F.when(F.trim(value) != "", value)


def _range_ends(location: Column) -> tuple[Column, Column]:
    """0-based start and end over all simple ranges of a location (single positions count as ranges)."""
    inner = F.regexp_replace(F.regexp_replace(location, r"(?i)complement\(|join\(|order\(|\)", ""), "[<>]", "")
    spans = F.filter(F.split(inner, ","), lambda p: F.rlike(p, F.lit(r"^\d+(\.\.\d+)?$")))
    starts = F.transform(spans, lambda p: F.regexp_extract(p, r"^(\d+)", 1).cast("int") - 1)
    ends = F.transform(spans, lambda p: F.regexp_extract(p, r"(\d+)$", 1).cast("int"))
    return F.array_min(starts), F.array_max(ends)


def _feature_type() -> Column:
    key, name = F.lower("key"), F.lower("name")
    product = F.lower(F.coalesce("product", F.lit("")))
    regulatory = F.coalesce("regulatory_class", F.lit(""))
    out = F.when(F.lit(False), "")
    for k, t in KEY_TYPES.items():
        out = out.when(key == k, t)
    out = out.when(_any(name, RESISTANCE) | _any(product, ["resistance", "lactamase"]), "Resistance")
    out = out.when(_any(name, REPORTER), "Reporter").when(_any(name, TAG), "Tag")
    for t, words in NAME_TYPES:
        out = out.when(_any(name, words), t)
    out = out.when(F.contains(name, F.lit("ori")) & _any(name, ORIGINS), "Origin").when(key.isin("cds", "gene"), "Gene")
    for word, t in (("promoter", "Promoter"), ("enhancer", "Enhancer"), ("terminator", "Terminator"), ("polyA", "PolyA"), ("poly_A", "PolyA")):
        out = out.when((key == "regulatory") & F.contains(regulatory, F.lit(word)), t)
    return out.when((key == "misc_feature") & F.contains(name, F.lit("ori")), "Origin").otherwise("Misc")


def _vector_name(text: Column) -> Column:
    """Plasmid name inside a description: a word p + capital, else the word after or before vector/plasmid."""
    p_name = F.rtrim(F.regexp_extract(text, r"\b(p[A-Z][A-Za-z0-9_.+()-]{1,30})\b", 1), F.lit(".,;"))
    p_name = F.rtrim(F.regexp_replace(p_name, r"(?i)(complete|sequence|vector|plasmid|DNA)$", ""), F.lit(" ,."))
    after = F.rtrim(F.regexp_extract(text, r"(?i)(?:vector|plasmid)\s+([A-Za-z][A-Za-z0-9_.+()-]{2,30})", 1), F.lit(".,"))
    ahead = F.rtrim(F.regexp_extract(text, r"(?i)([A-Za-z][A-Za-z0-9_.+-]*(?:\([+\-]\))?)\s+(?:vector|plasmid|DNA)", 1), F.lit(".,"))
    usable = lambda c: (F.length(c) >= 3) & ~c.isin("complete", "sequence")
    return F.when(F.length(p_name) >= 3, p_name).when(usable(after), after).when(usable(ahead), ahead)


def read_genbank(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sequences, features). Files without sequence are left out; features are 0-based and half-open."""
    records = _records(spark, path)
    start, end = _range_ends(F.col("location"))
    every = (
        _blocks(records)
        .withColumns({q: _qualifier(q) for q in ("label", "gene", "product", "note", "organism", "regulatory_class")})
        .withColumn("_n", F.coalesce("label", "gene", "product", "note"))
    )
    features = (
        every.where(F.lower("key") != "source")
        .withColumn("name", F.when(F.length("_n") > 50, F.concat(F.left("_n", F.lit(47)), F.lit("..."))).otherwise(F.coalesce("_n", "key")))
        .withColumn("start", start)
        .withColumn("end", end)
        .where(F.col("start").isNotNull())
        .select(
            F.col("file").alias("seq_id"),
            "name",
            _feature_type().alias("type"),
            "start",
            "end",
            F.rlike("location", F.lit(r"(?i)^complement\(")).alias("is_reverse"),
        )
    )
    names = features.groupBy("seq_id").agg(F.collect_set(F.lower("name")).alias("_f"))
    organism = every.where(F.lower("key") == "source").groupBy("file").agg(F.max_by("organism", "feature_no").alias("_organism"))
    locus = F.regexp_extract("text", r"(?m)^LOCUS\s+(\S+)", 1)
    definition = F.rtrim(
        F.trim(F.regexp_replace(F.regexp_extract("text", r"(?m)^DEFINITION((?:.*)(?:\n[ \t].*)*)", 1), r"\s*\n\s*", " ")), F.lit(".")
    )
    origin = F.regexp_extract("text", r"(?s)\nORIGIN[^\n]*\n(.*?)(?:\n//|$)", 1)
    linear = F.contains(F.upper(F.regexp_extract("text", r"(?m)^(LOCUS.*)$", 1)), F.lit("LINEAR"))
    base = (
        records.select(
            "file",
            locus.alias("_locus"),
            definition.alias("_def"),
            linear.alias("_linear"),
            F.regexp_replace(ascii_upper(origin), "[^A-Z]", "").alias("sequence"),
        )
        .where(F.length("sequence") > 0)
        .join(organism, "file", "left")
        .join(names, F.col("file") == F.col("seq_id"), "left")
        .drop("seq_id")
    )
    from_organism = _vector_name(F.col("_organism"))
    likely = (F.length(from_organism) >= 3) & F.startswith(F.lower(from_organism), F.lit("p"))
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    name = F.coalesce(F.when(likely, from_organism), _vector_name(F.col("_def")), F.nullif(F.col("_locus"), F.lit("")), stem)
    named = base.withColumn("name", name).withColumn(
        "description", F.when(F.col("_def") != "", F.col("_def")).when(F.col("_linear"), "(linear)").otherwise(F.col("name"))
    )
    has = lambda words: F.exists(F.coalesce("_f", F.array().cast("array<string>")), lambda f: _any(f, words))
    category = F.when(F.lit(False), "")
    for label, by_feature, by_name, by_text in CATEGORIES:
        hit = has(by_feature) | _any(F.lower("name"), by_name) | _any(F.lower("description"), by_text)
        if label == "E. coli Expression":
            hit = hit | F.exists(
                F.coalesce("_f", F.array().cast("array<string>")), lambda f: F.contains(f, F.lit("t7")) & F.contains(f, F.lit("promoter"))
            )
        category = category.when(hit, label)
    sequences = named.select(
        F.col("file").alias("seq_id"),
        "name",
        "description",
        category.otherwise("General").alias("category"),
        F.length("sequence").alias("size"),
        "sequence",
        (~F.col("_linear")).alias("is_circular"),
    )
    return sequences, features.join(sequences.select("seq_id"), "seq_id", "left_semi")


def isoform_label(text: Column) -> Column:
    """``Variant x`` or ``Isoform x`` from a description; NULL when neither is named."""
    variant = F.regexp_extract(text, r"(?i)transcript variant\s+(\w+)", 1)
    isoform = F.regexp_extract(text, r"(?i)isoform\s+(\w+)", 1)
    return F.when(variant != "", F.concat(F.lit("Variant "), variant)).when(isoform != "", F.concat(F.lit("Isoform "), isoform))


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Genomic records -> (transcripts, exons, cds_parts).

    Every mRNA feature is an isoform; the first CDS with its transcript id gives the coding parts. Parts are
    numbered by start, in 1-based closed coordinates. On the minus strand they are mapped onto the reverse
    complement of the gene's span, and ``template`` holds that text.
    """
    records = _records(spark, path)
    gene = F.regexp_extract("text", r'/gene="([^"]+)"', 1)
    accession = F.regexp_extract("text", r"ACCESSION\s+(\S+)", 1)
    blocks = _blocks(records).where(F.col("key").isin("mRNA", "CDS")).withColumns(
        {"tx": _qualifier("transcript_id"), "product": F.coalesce(_qualifier("product"), F.lit(""))}
    )
    spans = F.transform(
        F.regexp_extract_all("location", F.lit(r"<?(\d+\.\.>?\d+)"), 1),
        lambda p: F.struct(
            F.regexp_extract(p, r"^(\d+)", 1).cast("int").alias("start"), F.regexp_extract(p, r"(\d+)$", 1).cast("int").alias("end")
        ),
    )
    typed = blocks.withColumn("_spans", F.array_sort(spans)).withColumn("is_complement", F.startswith("location", F.lit("complement(")))
    order = Window.partitionBy("file").orderBy("feature_no")
    mrna = (
        typed.where(F.col("key") == "mRNA")
        .withColumn("_no", F.row_number().over(order))
        .where(F.size("_spans") > 0)
        .withColumn("transcript_id", F.coalesce("tx", F.concat(F.lit("Isoform"), F.col("_no").cast("string"))))
        .withColumn(
            "label",
            F.coalesce(isoform_label(F.col("product")), isoform_label(F.col("transcript_id")), F.concat(F.lit("Isoform "), F.col("_no").cast("string"))),
        )
    )
    cds = typed.where((F.col("key") == "CDS") & F.col("tx").isNotNull()).groupBy("file", "tx").agg(
        F.min_by("_spans", "feature_no").alias("_cds")
    )
    joined = mrna.join(cds.select("file", F.col("tx").alias("transcript_id"), "_cds"), ["file", "transcript_id"], "left").join(
        records.select("file", gene.alias("gene"), accession.alias("accession"), F.regexp_replace(
            ascii_upper(F.regexp_extract("text", r"(?s)\nORIGIN[^\n]*\n(.*?)(?:\n//|$)", 1)), "[^A-Z]", "").alias("_seq")),
        "file",
    )
    first = F.array_min(F.transform("_spans", lambda s: s["start"])) - 1
    last = F.least(F.array_max(F.transform("_spans", lambda s: s["end"])), F.when(F.length("_seq") > 0, F.length("_seq")).otherwise(F.lit(2**31 - 1)))
    placed = joined.withColumn("_from", F.greatest(first, F.lit(0))).withColumn("_to", last)

    def mapped(column: str) -> Column:
        flipped = F.array_sort(
            F.transform(column, lambda s: F.struct((F.col("_to") - s["end"] + 1).alias("start"), (F.col("_to") - s["start"] + 1).alias("end")))
        )
        return F.when(F.col("is_complement"), flipped).otherwise(F.col(column))

    from ..functions.sequences import ascii_slice, reverse_complement_n

    span = ascii_slice(F.encode("_seq", "UTF-8"), F.col("_from"), F.col("_to") - F.col("_from"))
    key = F.concat_ws("|", "file", "transcript_id")
    out = placed.select(
        key.alias("seq_id"),
        "accession",
        "gene",
        "transcript_id",
        "label",
        F.col("product").alias("product"),
        "is_complement",
        F.when(F.col("is_complement"), reverse_complement_n(span)).otherwise(F.col("_seq")).alias("template"),
        mapped("_spans").alias("_exons"),
        mapped("_cds").alias("_parts"),
    )
    exons = out.select("seq_id", F.posexplode("_exons").alias("_i", "_e")).select("seq_id", (F.col("_i") + 1).alias("exon"), "_e.start", "_e.end")
    parts = out.select("seq_id", F.posexplode("_parts").alias("_i", "_e")).select("seq_id", (F.col("_i") + 1).alias("part"), "_e.start", "_e.end")
    return out.drop("_exons", "_parts").orderBy(*natural_sort_keys("transcript_id", "transcript_id")), exons, parts
