"""The registered queries of the disclosure operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glasspane.functions import envelopes, keys, lengths, magic, paths, text, verdicts
from glasspane.functions.values import let
from glasspane.operators import archives, boxes, chunks, findings, headers, images, inspect, moving, rollups, sessions, tiff, trust
from glasspane.plans import tables as t
from glasspane.plans.tables import table
from glasspane.sources.artifacts import report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.octet_length("text").cast("long").alias("n"))


def _segment(url: str = "url") -> Column:
    """The last path segment of an address, without query and fragment."""
    return F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "([^/]*)/?$", 1)


# --- sizes: E1-E8 ---


@query
def padme_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("padded_size", lengths.size_class(F.col("n")))
    return d.groupBy("padded_size").agg(F.count("*").alias("n_docs"), F.sum(F.col("padded_size") - F.col("n")).alias("waste"))


@query
def padme_waste_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("p", lengths.padding(F.col("n")))
    return d.groupBy("source").agg(F.sum("n").alias("bytes"), F.sum("p").alias("padding"), F.max("p").alias("most"))


@query
def length_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.agg(F.countDistinct("n").alias("lengths_before"), F.countDistinct(lengths.size_class(F.col("n"))).alias("classes_after"))


@query
def chunk_and_cipher_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return _docs(spark, sf_dir).select("doc_id", "n", lengths.chunk_count(n).alias("chunks"), lengths.cipher_length(n).alias("cipher_bytes"))


@query
def recipient_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as recipients."""
    got = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("recipients"))
    return got.groupBy("recipients").agg(F.count("*").alias("messages")).withColumn("stanzas", lengths.padded_stanzas(F.col("recipients")))


@query
def envelope_size_by_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text to one to five recipients, signed, with its source as file name, in both suites."""
    suites = F.lit([f"{name}:{stanza}" for _, name, _, _, stanza in lengths.SUITES])
    d = _docs(spark, sf_dir).withColumn("suite", F.explode(suites))
    d = d.withColumns({"suite": F.substring_index("suite", ":", 1), "stanza": F.substring_index("suite", ":", -1).cast("long")})
    recipients = F.pmod("doc_id", F.lit(5)) + 1
    header = lengths.header_length(F.octet_length("source").cast("long"), F.lit(True), F.lit(False))
    size = lengths.envelope_length(lengths.size_class(F.col("n")), recipients, F.col("stanza"), header, F.lit(True))
    return d.withColumn("size", size).groupBy("suite").agg(F.sum("size").alias("total_bytes"), F.min("size").alias("least"), F.max("size").alias("most"))


@query
def stanza_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recipients' stanzas of an order sorted by body bytes."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(t.key_of("stanza", F.col("l_suppkey")))).alias("s"))
    return rows.select("l_orderkey", F.lower(F.array_join(F.transform("s", lambda x: F.left(F.hex(x), F.lit(8))), ",")).alias("stanzas"))


# --- formats: D1-D23, A1-A2, V1-V2 ---


@query
def format_verdict_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.col("text").cast("binary")
    d = _docs(spark, sf_dir).select("source", magic.detect(data).alias("format"), magic.hint(data).alias("hint"))
    verdict = verdicts.received(magic.understood(F.col("format")), F.lit(0), F.lit(True))
    return d.groupBy("source", F.coalesce("format", F.lit("")).alias("format"), F.coalesce("hint", F.lit("")).alias("hint"), verdict.alias("verdict")).agg(F.count("*").alias("files"))


@query
def format_verdict_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.col("html").cast("binary")
    p = table(spark, sf_dir, "pages").select(magic.detect(data).alias("format"))
    verdict = verdicts.received(magic.understood(F.col("format")), F.lit(0), F.lit(True))
    return p.groupBy(F.coalesce("format", F.lit("")).alias("format"), verdict.alias("verdict")).agg(F.count("*").alias("files"))


@query
def format_of_derived_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text wrapped in one of ten file heads; the content decides."""
    heads = F.lit(["89504E470D0A1A0A", "FFD8FFE0", "474946383961", "49492A00", "1A45DFA3", "4F676753", "255044462D", "504B0304", "3C7376673E", "1F8B08"])
    data = F.concat(F.unhex(F.get(heads, F.pmod("doc_id", F.lit(10)).cast("int"))), F.col("text").cast("binary"))
    d = _docs(spark, sf_dir).select("doc_id", F.coalesce(magic.detect(data), F.lit("")).alias("format"), F.coalesce(magic.hint(data), F.lit("")).alias("hint"))
    return d.groupBy("format", "hint").agg(F.count("*").alias("files"))


@query
def archive_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as archives whose entry names follow from their lines."""
    names = F.lit(["[Content_Types].xml", "word/document.xml", "xl/workbook.xml", "ppt/presentation.xml", "META-INF/container.xml", "META-INF/MANIFEST.MF", "AndroidManifest.xml"])
    got = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.get(names, F.pmod("l_partkey", F.lit(7)).cast("int"))).alias("names"))
    return got.groupBy(magic.archive_kind(F.col("names")).alias("kind")).agg(F.count("*").alias("archives"))


@query
def container_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as archives with a type entry, named after their segments, or none."""
    odf = lambda kind: F.lit(magic.ODF + kind)
    n = F.pmod("c_custkey", F.lit(7))
    said = F.when(n == 0, odf("text\n")).when(n == 1, odf("spreadsheet")).when(n == 2, odf("presentation")).when(n == 3, odf("graphics")).when(n == 4, "application/epub+zip").when(n == 5, F.concat(F.lit("application/"), "c_mktsegment"))
    names = F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.lit(["META-INF/MANIFEST.MF"])).otherwise(F.lit(["a.txt"]))
    return table(spark, sf_dir, "customer").groupBy(magic.archive_kind(names, said).alias("kind")).agg(F.count("*").alias("archives"))


@query
def size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: which texts pass a limit, and how many bytes stay outside."""
    d = _docs(spark, sf_dir).withColumn("accepted", F.col("n") <= 4096)
    return d.groupBy("accepted").agg(F.count("*").alias("files"), F.sum("n").alias("bytes"))


# --- metadata: M1, M3, M9-M13, M18-M20, M24, M26, M30, M33-M35; cleaning C1, C16 ---


def _pngs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select(F.col("doc_id").alias("artifact_id"), t.png_of(F.col("source"), F.col("text"), F.pmod("doc_id", F.lit(2)) == 0).alias("content"))


@query
def png_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.exploded(_pngs(spark, sf_dir), chunks.png_findings(F.col("content")))


@query
def png_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes before and after cleaning; cleaning again changes nothing and finds nothing."""
    p = _pngs(spark, sf_dir).withColumn("clean", chunks.png_cleaned(F.col("content")))
    again = chunks.png_cleaned(F.col("clean"))
    verdict = verdicts.cleaning(F.when(F.col("clean").isNull(), "malformed").otherwise("complete"))
    return p.select("artifact_id", F.octet_length("content").alias("bytes"), F.octet_length("clean").alias("clean_bytes"), (again == F.col("clean")).alias("stable"), F.size(chunks.png_findings(F.col("clean"))).alias("left"), verdict.alias("verdict"))


def _jpegs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("artifact_id"), t.jpeg_of(F.col("c_name"), F.pmod("c_custkey", F.lit(3)) == 0).alias("content"))


@query
def jpeg_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.exploded(_jpegs(spark, sf_dir), images.jpeg_findings(F.col("content")))


@query
def jpeg_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jpegs(spark, sf_dir).withColumn("clean", images.jpeg_cleaned(F.col("content")))
    return j.select("artifact_id", F.octet_length("content").alias("bytes"), F.lower(F.hex("clean")).alias("clean"), F.size(images.jpeg_findings(F.col("clean"))).alias("left"))


@query
def webp_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("artifact_id"), t.webp_of(F.col("s_name")).alias("content"))
    w = w.withColumn("clean", images.webp_cleaned(F.col("content")))
    kinds = F.array_join(F.transform(images.webp_findings(F.col("content")), lambda f: F.concat_ws(":", f["kind"], f["severity"], f["value"])), ",")
    return w.select("artifact_id", kinds.alias("found"), F.lower(F.hex("clean")).alias("clean"), F.size(images.webp_findings(F.col("clean"))).alias("left"))


@query
def bmp_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' addresses hidden behind a picture, none in every fourth."""
    tail = F.when(F.pmod("page_id", F.lit(4)) == 0, F.lit("")).otherwise(F.col("url"))
    b = table(spark, sf_dir, "pages").select(F.col("page_id").alias("artifact_id"), t.bmp_of(tail).alias("content"))
    found = F.array_join(F.transform(images.bmp_findings(F.col("content")), lambda f: F.concat_ws(":", f["kind"], f["severity"], f["value"])), ",")
    clean = images.bmp_cleaned(F.col("content"))
    return b.select("artifact_id", magic.detect(F.col("content")).alias("format"), found.alias("found"), F.octet_length(clean).alias("clean_bytes"))


def _told(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["severity"], f["location"], f["value"])), ",")


@query
def gif_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, C4: customers as pictures with a comment and application blocks of three kinds."""
    g = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("artifact_id"), t.gif_of(F.col("c_name"), F.pmod("c_custkey", F.lit(3))).alias("content"))
    g = g.withColumn("clean", moving.gif_cleaned(F.col("content")))
    return g.select("artifact_id", _told(moving.gif_findings(F.col("content"))).alias("found"), F.lower(F.hex("clean")).alias("clean"), F.size(moving.gif_findings(F.col("clean"))).alias("left"))


@query
def avi_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as films with a track name and a tool."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("artifact_id"), t.avi_of(F.col("c_name"), F.col("c_mktsegment")).alias("content"))
    a = a.withColumn("clean", moving.avi_cleaned(F.col("content")))
    return a.select("artifact_id", _told(moving.avi_findings(F.col("content"))).alias("found"), F.octet_length("content").alias("bytes"), F.octet_length("clean").alias("clean_bytes"), F.size(moving.avi_findings(F.col("clean"))).alias("left"), magic.detect(F.col("clean")).alias("format"))


@query
def stanza_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of an order as stanzas; how many of each type, and whether the types ascend as in a strict record."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    got = o.select("l_orderkey", t.stanzas_of(F.col("s")).alias("d"))
    tags = F.transform(chunks.stanzas(F.col("d"))["chunks"], lambda c: c["tag"])
    count = lambda tag: F.size(F.filter(tags, lambda x: x == tag))
    return got.select("l_orderkey", count("01").alias("real"), count("FF").alias("dummies"), chunks.tlv_fields(F.col("d"))["error"].isNull().alias("strict"))


@query
def mixed_file_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2, A3: customers as files of all formats that are read, as they are, with two bytes behind them, or cut short; what they say and what cleaning gives."""
    n, damage = F.pmod("c_custkey", F.lit(11)), F.pmod(F.floor(F.col("c_custkey") / 11), F.lit(3))
    name, x = F.col("c_name"), F.lit("xxxxx")
    made = [
        t.png_of(name, name, F.lit(False)), t.jpeg_of(name, F.lit(False)), t.webp_of(name), t.gif_of(name, F.lit(1)), t.bmp_of(F.lit("")), t.avi_of(name, x), t.wav_of(name, x),
        t.flac_of([F.concat(F.lit("ARTIST="), name)]), t.pdf_of(name, F.lit(1)), t.tiff_of(name, x, F.lit(0), True), F.concat(F.lit("OggS"), name).cast("binary"),
    ]
    content = F.lit(None).cast("binary")
    for i, file in enumerate(made):
        content = F.when(n == i, file).otherwise(content)
    content = let(content, lambda c: F.when(damage == 1, F.concat(c, F.lit("me").cast("binary"))).when(damage == 2, F.substr(c, F.lit(1), F.lit(20))).otherwise(c))
    files = table(spark, sf_dir, "customer").select(n.alias("made_as"), damage.alias("damage"), content.alias("content"))
    got = inspect.cleaned(files).select("made_as", "damage", F.coalesce("format", F.lit("")).alias("format"), "outcome", "verdict", F.coalesce(F.size("findings"), F.lit(-1)).alias("n_findings"))
    return got.groupBy("made_as", "damage", "format", "outcome", "verdict", "n_findings").agg(F.count("*").alias("files"))


@query
def tiff_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: customers as pictures in either byte order, some with a tail, a circle of directories, or a place."""
    variant = F.pmod("c_custkey", F.lit(4)).cast("int")
    made = [t.tiff_of(F.col("c_mktsegment"), F.col("c_name"), variant, small) for small in (True, False)]
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("artifact_id"), F.when(F.pmod("c_custkey", F.lit(3)) == 0, made[0]).otherwise(made[1]).alias("content"))
    r = c.select("artifact_id", tiff.tiff_report(F.col("content")).alias("r"))
    return r.select("artifact_id", F.col("r.error").alias("error"), _told(F.col("r.findings")).alias("found"))


@query
def exif_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: suppliers as photos whose Exif block names a device, a person and, for every fourth, a place."""
    variant = F.when(F.pmod("s_suppkey", F.lit(4)) == 3, 3).otherwise(0)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("artifact_id"), t.exif_of(t.tiff_of(F.lit("Camera One"), F.col("s_name"), variant, False)).alias("content"))
    return s.select("artifact_id", _told(images.jpeg_findings(F.col("content"))).alias("found"), F.lower(F.hex(images.jpeg_cleaned(F.col("content")))).alias("clean"))


def _zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as archives: an entry for each line, stored or packed, some pictures, some with paths of users; some archives with a comment or bytes behind."""
    where = F.get(F.lit(["", "home/me/", "C:\\x\\", "docs/"]), F.pmod("l_suppkey", F.lit(4)).cast("int"))
    picture = F.pmod("l_partkey", F.lit(3)) == 0
    data = F.when(picture, t.png_of(F.lit("k"), F.lit("v"), F.lit(False))).otherwise(F.repeat(F.lit("x"), F.col("l_linenumber")).cast("binary"))
    entry = F.struct("l_linenumber", F.col("l_partkey").alias("part"), where.alias("where"), F.concat(where, F.lit("f"), F.col("l_partkey")).alias("name"), F.when(F.pmod("l_linenumber", F.lit(2)) == 1, 0).otherwise(8).alias("method"), data.alias("data"))
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    comment = F.when(F.pmod("l_orderkey", F.lit(3)) == 1, "note").otherwise("")
    made = F.concat(t.zip_of(F.col("e"), comment), F.when(F.pmod("l_orderkey", F.lit(5)) == 0, F.lit("zz")).otherwise("").cast("binary"))
    return o.select("l_orderkey", F.when(F.pmod("l_orderkey", F.lit(7)) == 0, F.substr(made, F.lit(1), F.octet_length(made) - 30)).otherwise(made).alias("content"))


@query
def zip_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directories of archives from their bytes, entry by entry."""
    return archives.entries(_zips(spark, sf_dir), "l_orderkey").select("l_orderkey", "i", "name", "method", "size", "offset", "error")


@query
def zip_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What archives and the names in them tell."""
    return _zips(spark, sf_dir).select("l_orderkey", _told(archives.zip_findings(F.col("content"))).alias("found"))


@query
def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that are stored as they are, inspected as files of their own."""
    got = inspect.inspected(archives.members(_zips(spark, sf_dir), "l_orderkey"))
    return got.groupBy(F.coalesce("format", F.lit("")).alias("format"), "verdict", F.coalesce(F.size("findings"), F.lit(-1)).alias("n_findings")).agg(F.count("*").alias("files"))


@query
def film_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as films; each item of the tag list has its name at the place of the key directory that its number says."""
    n = F.col("c_custkey")
    places = F.filter(F.array(F.lit(3), F.lit(1), F.lit(4), F.lit(2)), lambda k: F.pmod(n + k, F.lit(3)) != 0)
    values = [F.concat(F.lit("+"), n, F.lit("/")), F.col("c_mktsegment"), F.col("c_name"), F.lit("2024-01-02")]
    c = table(spark, sf_dir, "customer").select(n.alias("artifact_id"), t.film_of(values, places, F.pmod(n, F.lit(5)) == 0).alias("content"))
    cut = F.when(F.pmod("artifact_id", F.lit(10)) == 9, F.substr("content", F.lit(1), F.octet_length("content") - 1)).otherwise(F.col("content"))
    r = c.select("artifact_id", boxes.video_report(cut).alias("r"))
    return r.select("artifact_id", F.col("r.error").alias("error"), _told(F.col("r.findings")).alias("found"))


def _wavs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("artifact_id"), t.wav_of(F.col("c_name"), F.col("c_mktsegment")).alias("content"))


@query
def riff_info_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _wavs(spark, sf_dir).select("artifact_id", F.posexplode(chunks.riff_info(F.col("content"))).alias("ord", "f")).select("artifact_id", "ord", "f.tag", "f.value")
    return findings.classified(got, findings.rule_table(spark, findings.RIFF_INFO), F.col("tag"), ("comment", 1)).select("artifact_id", "ord", "tag", "value", "kind", "severity")


@query
def riff_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telling chunks become JUNK in place: the length stays and no field is left."""
    w = _wavs(spark, sf_dir).withColumn("clean", chunks.riff_cleaned(F.col("content")))
    return w.select("artifact_id", F.octet_length("content").alias("bytes"), F.octet_length("clean").alias("clean_bytes"), F.size(chunks.riff_info(F.col("clean"))).alias("left"), magic.detect(F.col("clean")).alias("format"))


@query
def flac_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sound files with three comments each."""
    entry = lambda k, v: F.concat(F.lit(f"{k}="), v)
    s = table(spark, sf_dir, "supplier")
    data = t.flac_of([entry("Artist", F.col("s_name")), entry("DATE", F.col("s_nationkey").cast("string")), entry("note", F.col("s_suppkey").cast("string"))])
    files = s.select(F.col("s_suppkey").alias("artifact_id"), data.alias("content"))
    block = F.filter(chunks.flac_blocks(F.col("content"))["chunks"], lambda c: c["tag"] == "4")
    found = files.withColumn("c", F.explode(block)).withColumn("v", chunks.vorbis_comments(chunks.body(F.col("content"), F.col("c"))))
    rows = found.select("artifact_id", F.posexplode("v.entries").alias("ord", "e")).select("artifact_id", "ord", "e.key", "e.value")
    upper = F.translate("key", text.LOWER, text.UPPER)
    return findings.classified(rows, findings.rule_table(spark, findings.VORBIS), upper, ("comment", 1)).select("artifact_id", "ord", "key", "value", "kind", "severity")


def _pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("artifact_id"), t.pdf_of(F.col("s_name"), (F.pmod("s_suppkey", F.lit(3)) + 1).cast("int")).alias("content"))


@query
def pdf_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.exploded(_pdfs(spark, sf_dir), chunks.pdf_findings(F.col("content")))


@query
def pdf_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _pdfs(spark, sf_dir).select("artifact_id", F.posexplode(chunks.pdf_revisions(F.col("content"))).alias("k", "bytes"))
    return got.select("artifact_id", (F.col("k") + 1).alias("number"), "bytes")


@query
def html_outside_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference rule of vector images on the addresses of pages."""
    refs = F.regexp_extract_all("html", F.lit("(?:href|src)=\"([^\"]*)\""), F.lit(1))
    p = table(spark, sf_dir, "pages").select("page_id", refs.alias("r"))
    return p.select("page_id", F.size("r").alias("n_refs"), F.size(F.filter("r", text.points_outside)).alias("n_outside"))


@query
def html_active_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda pattern: F.regexp_count("html", F.lit(pattern))
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", count("<script").alias("scripts"), count("<!--").alias("comments"), count(r"\son[a-z]+=").alias("handlers"), text.shown(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query
def path_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as entry names, and addresses moved into user folders."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("name"))
    moved = table(spark, sf_dir, "pages").select(
        F.concat(F.get(F.lit(["C:\\Users\\", "home/", "x/HOME/", "D:/", "share/"]), F.pmod("page_id", F.lit(5)).cast("int")), _segment()).alias("name")
    )
    got = lines.unionByName(moved).select(F.coalesce(text.path_leak(F.col("name")), F.lit("none")).alias("leak"))
    return got.groupBy("leak").agg(F.count("*").alias("names"))


@query
def filename_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last segments of addresses as received names, some made unsafe."""
    extra = F.get(F.lit(["", "con.", "a:b ", "\u202e", "\t", "nul"]), F.pmod("page_id", F.lit(6)).cast("int"))
    p = table(spark, sf_dir, "pages").select(F.concat(extra, _segment()).alias("name"))
    return p.groupBy(F.coalesce(text.filename_fault(F.col("name")), F.lit("accepted")).alias("fault")).agg(F.count("*").alias("names"))


@query
def cleaned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned names, and free ones where a host has several of one name."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/]*)", 1).alias("host"), F.concat(_segment(), F.lit(".html")).alias("name"))
    p = p.withColumn("name", text.cleaned_name(F.col("name")))
    return rollups.free_names(p, "name", "page_id", "host").select("page_id", "name", "free_name")


@query
def value_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.shown(F.col("text")).alias("value"))


def _events_as_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("event_type").isin("purchase", "signup"), 2).when(F.col("event_type") == "error", 1).otherwise(0)
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("artifact_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("kind"), F.concat(F.lit("props:"), F.pmod("event_id", F.lit(3)).cast("string")).alias("location"), F.col("props").alias("value"), severity.alias("severity"))


@query
def keep_first_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.collapse(_events_as_findings(spark, sf_dir))


@query
def severity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of each artifact, the most severe first, file order among equals."""
    return findings.worst_first(_events_as_findings(spark, sf_dir)).select("artifact_id", "place", "ord", "severity")


@query
def critical_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.critical_summary(_events_as_findings(spark, sf_dir))


@query
def tracked_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, lines as changes: returned ones delete, the ship month signs."""
    kind = F.when(F.col("l_returnflag") == "R", "del").otherwise("ins")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("artifact_id"), kind.alias("kind"), F.date_format("l_shipdate", "yyyy-MM").alias("author"))
    return findings.tracked_changes(rows, "artifact_id")


@query
def lines_only_in_older_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last turn of a conversation as revisions, both with the shared first line of the last."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("old"), F.max_by("text", "turn").alias("new"))
    shared = F.substring_index("new", "\n", 1)
    got = c.select("conv_id", findings.only_in_older(F.concat_ws("\n", "old", shared, "old"), F.col("new")).alias("lines"))
    return got.select("conv_id", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("lines_md5"))


# --- keys and trust: T1-T16, T20-T21, E14, A11 ---


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = t.spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"), F.col("c_custkey")
    enc = t.key_of("enc", n)
    sig = F.when(F.pmod(n, F.lit(3)) != 0, t.key_of("sig", n))
    pq = F.when(F.pmod(n, F.lit(2)) == 0, F.unhex(F.repeat(F.hex(t.key_of("pq", n)), 38)))
    return c.select("c_custkey", enc.alias("enc"), sig.alias("sig"), pq.alias("pq"))


@query
def key_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _keys(spark, sf_dir).withColumn("fp", keys.fingerprint(F.col("enc"), F.col("sig"), F.col("pq")))
    return k.select("c_custkey", F.lower(F.hex("fp")).alias("fingerprint"), keys.display_full(F.col("fp")).alias("full"), keys.display(F.col("fp")).alias("shown"), keys.short(F.col("fp")).alias("short"))


@query
def base32_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as base32, read back from a careless copy."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", text.base32(F.col("c_name").cast("binary")).alias("b32"))
    careless = F.translate(F.lower(text.grouped(F.col("b32"))), "01", "ol")
    return c.select("c_custkey", "b32", text.base32_bytes(careless).cast("string").alias("back"))


@query
def exchange_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads, some damaged on the way, some foreign; of those read, whether the signer is a contact."""
    n = F.col("c_custkey")
    k = _keys(spark, sf_dir).withColumn("p", keys.payload(F.col("enc"), F.col("sig"), F.col("pq")))
    sent = F.when(F.pmod(n, F.lit(7)) == 0, F.concat(F.lit("x"), "p")).when(F.pmod(n, F.lit(11)) == 0, F.regexp_replace("p", ".$", "")).otherwise(F.col("p"))
    got = k.select("c_custkey", keys.read_payload(sent).alias("r"))
    # payloads without a signer look for their own number, which no key of a contact is, so that they are not one group of the join
    signer = F.coalesce(F.when(F.col("r.status") == "read", F.col("r.sig_pub")), n.cast("string").cast("binary"))
    got = got.select("c_custkey", F.col("r.status").alias("status"), signer.alias("signer"))
    known = t.contacts_of(table(spark, sf_dir, "customer")).select(F.col("sig_pub").alias("k"), F.lit(True).alias("known")).where("k is not null")
    return got.join(known, F.col("signer") == F.col("k"), "left").select("c_custkey", "status", F.coalesce("known", F.lit(False)).alias("known"))


@query
def safety_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with the next one; both sides see one number."""
    k = _keys(spark, sf_dir).select("c_custkey", keys.fingerprint(F.col("enc"), F.col("sig"), F.col("pq")).alias("fp"))
    other = k.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("fp").alias("fp2"))
    return k.join(other, "c_custkey").select("c_custkey", keys.safety_number(F.col("fp2"), F.col("fp")).alias("number"))


@query
def transcript_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest over the digests of prologue, header and payload."""
    part = lambda c: F.unhex(F.sha2(c.cast("binary"), 256))
    whole = F.concat(F.lit("transcript").cast("binary"), part(F.col("source")), part(F.col("n").cast("string")), part(F.col("text")))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(whole, 256).alias("transcript"))


@query
def resolve_signers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages, customers as contacts."""
    got = trust.resolve_signers(t.messages_of(table(spark, sf_dir, "events")), t.contacts_of(table(spark, sf_dir, "customer")))
    return got.select("message_id", "case", "contact_ord", F.lower(F.hex("previous_fingerprint")).alias("previous_fingerprint"), "previous_verified", verdicts.sender(F.col("case")).alias("verdict"))


@query
def added_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as new contacts; some have a customer's key, some share one, some have none."""
    s, n = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    key = F.when(F.pmod(n, F.lit(4)) == 0, t.key_of("sig", n)).when(F.pmod(n, F.lit(4)) == 1, t.key_of("new", F.pmod(n, F.lit(10)))).when(F.pmod(n, F.lit(4)) == 2, t.key_of("new", n))
    new = s.select(n.alias("ord"), F.col("s_name").alias("name"), key.alias("sig_pub"))
    return trust.added(t.contacts_of(table(spark, sf_dir, "customer")), new).select("ord", "name")


@query
def contacts_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First contact of each segment name, whatever its ASCII case."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), text.ascii_lower(F.col("c_mktsegment")).alias("key"), "c_name")
    return trust.first_match(c, "key").select("key", "ord", "c_name")


@query
def contact_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some contacts removed, some renamed after their segments."""
    customers = table(spark, sf_dir, "customer")
    gone = customers.where(F.pmod("c_custkey", F.lit(7)) == 0).select(F.col("c_custkey").alias("ord"))
    names = customers.where(F.pmod("c_custkey", F.lit(5)) == 0).select(F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("name"))
    return trust.listed(trust.renamed(trust.removed(t.contacts_of(customers), gone), names))


@query
def contact_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4."""
    c = t.contacts_of(table(spark, sf_dir, "customer"))
    return c.groupBy("state", verdicts.contact(F.col("state")).alias("verdict")).agg(F.count("*").alias("contacts"))


@query
def trust_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's day is a contact; clicks verify, views unverify, purchases replace keys, errors on full hours revoke."""
    minute = F.minute("ts")
    action = F.when(F.col("event_type") == "click", "verify").when(F.col("event_type") == "view", "unverify").when(F.col("event_type") == "purchase", "replace").when((F.col("event_type") == "error") & (minute < 5), "revoke")
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", F.to_date("ts")).alias("contact_id"), F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), action.alias("action"))
    return trust.fold_trust(e)


@query
def send_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages to their suppliers."""
    n = F.col("s_suppkey")
    state = F.when(F.pmod(n, F.lit(50)) == 3, "revoked").when(F.pmod(n, F.lit(5)) == 0, "changed").when(F.pmod(n, F.lit(5)) == 1, "seen").otherwise("verified")
    people = table(spark, sf_dir, "supplier").where(F.pmod(n, F.lit(40)) != 7).select(n.alias("contact"), state.alias("state"), (F.pmod(n, F.lit(3)) != 0).alias("hybrid"))
    to = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_suppkey").alias("contact")).distinct()
    return trust.plan_sends(to, people)


HEAD, FOOT = "-----BEGIN MESSAGE-----", "-----END MESSAGE-----"


@query
def armor_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in armor, quoted as in a reply, and read back."""
    a = text.armored(F.col("text").cast("binary"), HEAD, FOOT)
    d = _docs(spark, sf_dir).withColumn("a", a)
    quoted = F.concat(F.lit("Hello\n> "), F.regexp_replace("a", "\n", "\n> "), F.lit("\nregards"))
    back = text.armored_bytes(quoted, HEAD, FOOT)
    return d.select("doc_id", F.length("a").alias("armor_chars"), (back == F.col("text").cast("binary")).alias("same"))


# --- structure: E9, E10, E17, E18 ---


@query
def envelope_outside_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as envelope heads (magic, suite, stanza count); what they show without a key."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("c"))
    suite = F.pmod("l_orderkey", F.lit(3)).cast("long")
    data = F.concat(F.lit("E2").cast("binary"), F.unhex(F.lpad(F.hex(suite), 4, "0")), F.unhex(F.lpad(F.hex(F.col("c")), 2, "0")))
    seen = o.select("c", envelopes.outside_view(data, b"E2").alias("v"))
    name = F.when(F.col("v.error") == "unsupported suite", "unsupported").otherwise(F.col("v.suite"))
    return seen.groupBy(name.alias("suite"), F.coalesce("v.stanzas", F.col("c").cast("int")).alias("stanzas")).agg(F.count("*").alias("envelopes"))


@query
def outside_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as messages of both versions, some foreign, cut or of an unknown suite."""
    n, body = F.pmod("doc_id", F.lit(5)), F.col("text").cast("binary")
    old = F.regexp_replace(F.base64(F.concat(F.lit('{"header":').cast("binary"), body)), "[\\r\\n]", "").cast("binary")
    head = lambda digits: F.concat(F.unhex(F.lit(digits)), body)
    data = F.when(n == 0, F.concat(F.lit("\n ").cast("binary"), old)).when(n == 1, head("4532000203")).when(n == 2, body).when(n == 3, F.unhex(F.lit("45320001"))).otherwise(head("4532000901"))
    return _docs(spark, sf_dir).select("doc_id", envelopes.outside_view(data, b"E2").alias("v")).select("doc_id", "v.*")


@query
def old_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts behind the first bytes of old messages and key files."""
    head = F.get(F.lit(["\n eyJ", "\t{", "", "x{"]), F.pmod("doc_id", F.lit(4)).cast("int"))
    d = _docs(spark, sf_dir).select(envelopes.old_format(F.concat(head, "text").cast("binary")).alias("f"))
    return d.groupBy(F.coalesce("f", F.lit("none")).alias("old_format")).agg(F.count("*").alias("files"))


@query
def header_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as message headers, six of eight with a fault."""
    n = F.pmod("c_custkey", F.lit(8))
    rows = t.spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    c = rows.select("c_custkey", headers.header_fields(t.header_of(F.col("c_custkey"), F.regexp_replace("c_name", "#", "_"), n)).alias("h"))
    return c.select("c_custkey", F.col("h.error").alias("error"), F.col("h.content_type").alias("content_type"), F.col("h.plaintext_size").cast("long").alias("plaintext_size"), F.col("h.signed").alias("signed"), F.lower(F.hex("h.sender_key")).alias("sender_key"), F.col("h.filename").alias("filename"))


@query
def old_message_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as base64 JSON messages; what can be read without a key."""
    c = table(spark, sf_dir, "customer")
    body = F.to_json(F.struct(F.col("c_name").alias("filename"), F.col("c_custkey").alias("size"), F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.col("c_mktsegment")).alias("sender")))
    sent = c.select("c_custkey", F.base64(body.cast("binary")).alias("m"))
    got = sent.select("c_custkey", F.from_json(F.unbase64("m").cast("string"), "filename string, size long, sender string").alias("x"))
    return got.select("c_custkey", F.col("x.filename").alias("filename"), F.col("x.size").alias("size"), F.col("x.sender").isNotNull().alias("names_sender"))


@query
def derivation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters in range, and the level that matches exactly."""
    p = table(spark, sf_dir, "part").select(F.get(F.lit([65536, 262144, 1048576, 100]), F.pmod("p_partkey", F.lit(4)).cast("int")).alias("memory"), (F.pmod("p_size", F.lit(4)) + 1).alias("passes"))
    level = F.when((F.col("memory") == 65536) & (F.col("passes") == 3), "low").when((F.col("memory") == 262144) & (F.col("passes") == 3), "middle").when((F.col("memory") == 1048576) & (F.col("passes") == 4), "high")
    return p.groupBy(F.col("memory").between(8192, 4194304).alias("valid"), F.coalesce(level, F.lit("custom")).alias("level")).agg(F.count("*").alias("files"))


# --- sessions: V8-V11 ---


@query
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.idle_sessions(table(spark, sf_dir, "events"), "user_id", "ts")


@query
def idle_sessions_without_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views only ask for the state and do not prolong a session."""
    return sessions.idle_sessions(table(spark, sf_dir, "events"), "user_id", "ts", 3600, F.col("event_type") == "view")


@query
def idle_lock_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8-V10 at noon of the first of February, with a limit of twelve hours."""
    now, limit = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), 43_200
    e = table(spark, sf_dir, "events").where(F.col("ts") < now)
    got = sessions.lock_states(e, "user_id", "ts", now, limit)
    return got.select("user_id", "remaining", "locked", verdicts.countdown(F.col("remaining"), F.lit(limit)).alias("level"))


# --- roll-ups, deletion, reports: V5, V7, S1-S3, S5-S7, A10 ---


@query
def batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a source as a batch: those over 4000 bytes come out partial, every tenth is not understood."""
    outcome = F.when(F.pmod("doc_id", F.lit(10)) == 9, "unknown").when(F.col("n") > 4000, "partial").otherwise("complete")
    return rollups.batch_rollup(_docs(spark, sf_dir).select("source", verdicts.cleaning(outcome).alias("verdict")), "source")


@query
def conspicuous_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: the files of each batch that are named one by one."""
    outcome = F.when(F.pmod("doc_id", F.lit(10)) == 9, "unknown").when(F.col("n") > 4000, "partial").otherwise("complete")
    return rollups.conspicuous(_docs(spark, sf_dir).select("source", "doc_id", verdicts.cleaning(outcome).alias("verdict"))).select("source", "doc_id")


@query
def tree_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as a tree of files, links and directories."""
    p = table(spark, sf_dir, "pages")
    kind = F.when(F.pmod("page_id", F.lit(11)) == 0, "link").otherwise("file")
    files = p.select(F.col("url").alias("path"), kind.alias("kind"), F.octet_length("html").cast("long").alias("bytes"))
    dirs = p.select(F.regexp_extract("url", "^(.*)/[^/]*$", 1).alias("path"), F.lit("dir").alias("kind"), F.lit(0).cast("long").alias("bytes")).distinct()
    return rollups.tree_preview(files.unionByName(dirs))


@query
def refusal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts as directories in places of ten kinds; every twentieth is confirmed by a wrong name."""
    n, host = F.pmod("page_id", F.lit(10)).cast("int"), F.regexp_extract("url", "//([^/]*)", 1)
    place = F.get(F.lit(["/", "C:\\", "/home/", "/usr/", "/VAR/folders/", "C:\\Program Files (x86)\\", "/private/etc/", "/data/", "/data/", "/usrdata/"]), n)
    path = F.when(n < 2, place).otherwise(F.concat(place, host))
    sure = F.when(F.pmod("page_id", F.lit(20)) == 9, "other").otherwise(host)
    p = table(spark, sf_dir, "pages").select(paths.refusal(path, sure, F.concat(F.lit("/home/"), host), F.lit(True), n == 8, n == 7).alias("r"))
    return p.groupBy(F.coalesce("r", F.lit("allowed")).alias("refusal")).agg(F.count("*").alias("directories"))


@query
def directory_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("url", F.octet_length("html").cast("long").alias("bytes"))
    return rollups.directory_preview(p, "url", "bytes")


@query
def outcome_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results of a user's batch; errors fail and warn, purchases warn."""
    kind = F.col("event_type")
    warning = F.when(kind == "error", "was read-only").when(kind == "purchase", "copies may exist").when(kind == "signup", "cloud folder")
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), (kind != "error").alias("ok"), warning.alias("warning"))
    return rollups.outcomes(e, "user_id")


@query
def mount_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as paths; the first ten characters, the hosts and the language folders as mounts."""
    p = table(spark, sf_dir, "pages")
    cuts = [(F.left("url", F.lit(10)), "ext4"), (F.regexp_extract("url", "^([a-z]+://[^/]+)", 1), "btrfs"), (F.regexp_extract("url", "^([a-z]+://[^/]+/[a-z]+)", 1), "zfs")]
    mounts = p.select(F.explode(F.array(*[F.struct(m.alias("mount"), F.lit(k).alias("fstype")) for m, k in cuts])).alias("x")).select("x.*")
    mounts = mounts.where("mount != ''").groupBy("mount").agg(F.max("fstype").alias("fstype"))
    got = rollups.longest_mount(p.select(F.col("url").alias("path")), mounts)
    return got.withColumn("copy_on_write", F.col("fstype").isin("btrfs", "zfs", "bcachefs"))


@query
def deletion_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three answers, each possibly unknown."""
    known = lambda m: F.get(F.lit([True, False, None]), F.pmod(F.floor(F.col("p_partkey") / m).cast("long"), F.lit(3)).cast("int"))
    p = table(spark, sf_dir, "part").select(known(1).alias("rotating"), known(3).alias("copy_on_write"), known(9).alias("virtual"))
    return p.groupBy(verdicts.deletion(F.col("rotating"), F.col("copy_on_write"), F.col("virtual")).alias("capability")).agg(F.count("*").alias("files"))


@query
def cloud_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.get(F.lit(["/OneDrive/", "/Dropbox/", "/Google Drive/", "/iCloud/", "/nextcloud/", "/pCloud/", "/data/"]), F.pmod("page_id", F.lit(7)).cast("int"))
    p = table(spark, sf_dir, "pages").select(text.cloud_hint(F.concat(folder, "url")).alias("hint"))
    return p.groupBy(F.coalesce("hint", F.lit("none")).alias("hint")).agg(F.count("*").alias("paths"))


@query
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", text.human_size(F.col("n") * F.col("n")).alias("size"))


@query
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: one line of JSON for each artifact."""
    d = _docs(spark, sf_dir).select("doc_id", F.struct(F.col("doc_id").alias("id"), F.col("source"), F.col("n").alias("bytes")).alias("r"))
    return report(d, "r").select("doc_id", "line")
