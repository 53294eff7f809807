"""Files of any format: findings, what cleaning gives, and verdicts.

A format that is detected but not read has no findings and no clean verdict:
it is not understood. A broken file of a format that is read is an error row.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from glasspane.functions import magic, verdicts
from glasspane.functions.values import let
from glasspane.operators import chunks, images, moving, tiff

#: What reads a file of each format: an error, or findings; and whether all of it stands in the clear, where that is not sure.
REPORTS = {
    "PNG": chunks.png_report, "JPEG": images.jpeg_report, "WebP": images.webp_report, "BMP": images.bmp_report, "PDF": chunks.pdf_report,
    "WAV": chunks.wav_report, "FLAC": chunks.flac_report, "GIF": moving.gif_report, "AVI": moving.avi_report, "TIFF": tiff.tiff_report,
}
CLEANERS = {
    "PNG": chunks.png_cleaned, "JPEG": images.jpeg_cleaned, "WebP": images.webp_cleaned, "WAV": chunks.riff_cleaned, "BMP": images.bmp_cleaned,
    "FLAC": chunks.flac_cleaned, "GIF": moving.gif_cleaned, "AVI": moving.avi_cleaned,
}
#: Formats that are read but not cleaned.
ONLY_READ = ("PDF", "TIFF")


def report_of(form: Column, data: Column) -> Column:
    """``error, findings, open`` by format, from one walk of the format's reader; null for a format that is not read."""

    def by_format(d: Column) -> Column:
        out = F.lit(None).cast(f"struct<error:string,findings:{chunks.FINDINGS},open:boolean>")
        for name, reader in REPORTS.items():
            got = reader(d) if name == "PDF" else let(reader(d), lambda r: F.struct(r["error"].alias("error"), r["findings"].alias("findings"), F.lit(True).alias("open")))
            out = F.when(form == name, got).otherwise(out)
        return out

    return let(data, by_format)


@cache
def _report(application: str) -> Column:
    """The readers' expression on ``format`` and ``content``: it is large, so each session puts it together once."""
    return report_of(F.col("format"), F.col("content"))


@cache
def _cleaner(application: str) -> Column:
    def by_format(d: Column) -> Column:
        out = F.lit(None).cast("binary")
        for name, cleaner in CLEANERS.items():
            out = F.when(F.col("format") == name, cleaner(d)).otherwise(out)
        return out

    return let(F.col("content"), by_format)


def inspected(files: DataFrame) -> DataFrame:
    """Adds format, hint, understood, error, findings and the verdict on a received file.

    Each row meets the reader of its format alone. A PDF with packed or encrypted
    objects is not understood: its bytes do not show what it tells. Columns of
    these names, and one named ``_report``, are replaced.
    """
    data = F.col("content")
    got = files.withColumn("format", magic.detect(data)).withColumn("_report", _report(files.sparkSession.sparkContext.applicationId))
    understood = magic.understood(F.col("format")) & (F.col("_report.error").isNotNull() | F.coalesce(F.col("_report.open"), F.lit(False)))
    got = got.withColumns({"hint": magic.hint(data), "error": F.col("_report.error"), "understood": F.coalesce(understood, F.lit(False))})
    got = got.withColumn("findings", F.when(F.col("understood"), F.col("_report.findings"))).drop("_report")
    verdict = verdicts.received(F.col("understood"), F.coalesce(F.size("findings"), F.lit(0)), F.col("error").isNull())
    return got.withColumn("verdict", verdict)


def progress(inspected: DataFrame, observation: Observation | str) -> DataFrame:
    """The rows as they are; ``observation`` gets their metrics while they are written, without a second pass.

    Files, bytes, faults, findings and one count for each verdict. A batch reads
    them from an ``Observation``; a stream names one, and a listener finds it in
    ``observedMetrics`` of each batch's progress.
    """
    counts = [F.count_if(F.col("verdict") == v).alias(v.replace(" ", "_")) for v in (verdicts.CONFIRMED, verdicts.WARNING, verdicts.SILENT, verdicts.ERROR)]
    size = F.octet_length("content")
    return inspected.observe(
        observation, F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.coalesce(F.max(size), F.lit(0)).alias("largest"),
        F.count_if(F.col("error").isNotNull()).alias("faults"), F.coalesce(F.sum(F.greatest(F.size("findings"), F.lit(0))), F.lit(0)).alias("findings"), *counts,
    )


def cleaned(files: DataFrame) -> DataFrame:
    """Adds outcome (complete, partial, unknown, malformed), the bytes after cleaning and the verdict.

    A BMP with a profile, a FLAC file with a cue sheet or blocks of unknown types,
    a WAV, AVI or WebP file with chunks of unknown names, and every PDF and
    TIFF file with findings are cleaned in part only; the bytes of what is not understood or broken stay
    as they are.
    """
    data, form = F.col("content"), F.col("format")
    got = inspected(files).drop("verdict")

    foreign = lambda f: (f["kind"] == "unknown extension") & ~f["location"].isin("WAV:id3", "WAV:filler", "AVI:filler")
    stays = lambda f: (
        f["location"].isin("BMP:profile", "BMP:length", "FLAC:cue sheet")
        | F.startswith(f["location"], F.lit("FLAC:block "))
        | F.startswith(f["location"], F.lit("between scans"))
        | (F.startswith(f["location"], F.lit("PNG:")) & f["location"].isin(*[f"PNG:{c}" for c in chunks.PNG_KEPT]))
        | (foreign(f) & form.isin("WAV", "WebP", "AVI"))
    )
    partial = (form.isin(*ONLY_READ) & (F.size("findings") > 0)) | (form == "PDF") | F.coalesce(F.exists("findings", stays), F.lit(False))
    outcome = F.when(F.col("error").isNotNull(), "malformed").when(~F.col("understood"), "unknown").when(partial, "partial").otherwise("complete")
    got = got.withColumns({"outcome": outcome, "cleaned": F.coalesce(_cleaner(files.sparkSession.sparkContext.applicationId), data)})
    return got.withColumn("verdict", verdicts.cleaning(F.col("outcome")))
