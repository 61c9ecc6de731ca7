"""Zip archives of text members, streamed inside tasks."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators.pairing import resolve_pair_source
from tandem.session import staged

DROPPED_MEMBERS = r"(\.scores|(^|/)LICENSE|(^|/)README)$"


def _open(path: str):
    filesystem, inner = fs.FileSystem.from_uri(path)
    return filesystem.open_input_file(inner)


def read_archive_lines(spark: SparkSession, glob: str, batch_rows: int = 10_000) -> DataFrame:
    """``path, member, line_no, line`` of every text member but scores, licence and readme.

    Only paths are scanned; each (archive, member) is one task that streams the
    member in small batches, so neither an archive nor a member has to fit in memory.
    """
    files = spark.read.format("binaryFile").load(glob).select("path")

    def list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with _open(path) as handle, zipfile.ZipFile(handle) as archive:
                    names = [n for n in archive.namelist() if not n.endswith("/")]
                yield pd.DataFrame({"path": path, "member": names})

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, member in zip(batch["path"], batch["member"]):
                with _open(path) as handle, zipfile.ZipFile(handle) as archive, archive.open(member) as raw:
                    lines, first = [], 1
                    for line in io.TextIOWrapper(raw, encoding="utf-8"):
                        lines.append(line.rstrip("\n"))
                        if len(lines) == batch_rows:
                            yield _numbered(path, member, first, lines)
                            first, lines = first + len(lines), []
                    if lines:
                        yield _numbered(path, member, first, lines)

    members = files.mapInPandas(list_members, "path string, member string").where(~F.col("member").rlike(DROPPED_MEMBERS))
    # spread the members: listing leaves them where their archive was
    return members.repartition("path", "member").mapInPandas(
        stream, "path string, member string, line_no long, line string"
    )


def _numbered(path: str, member: str, first: int, lines: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"path": path, "member": member, "line_no": range(first, first + len(lines)), "line": lines})


PAIR_ARCHIVE = r"([A-Za-z_]+)-([A-Za-z_]+)(?:\.[A-Za-z]+)?\.zip$"


def _member(archive: zipfile.ZipFile, lang: str) -> str | None:
    """The text member of a language; of several the first by name."""
    return min((n for n in archive.namelist() if n.endswith(f".{lang}") and not re.search(DROPPED_MEMBERS, n)), default=None)


def _line_ends(archive: zipfile.ZipFile, member: str) -> int:
    """Lines of a member, without building them."""
    found, last = 0, b"\n"
    with archive.open(member) as raw:
        while chunk := raw.read(1 << 20):
            found, last = found + chunk.count(b"\n"), chunk[-1:]
    return found + (last != b"\n")


def _lines(raw) -> Iterator[str]:
    for line in raw:
        yield line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")


def read_archive_bitext(spark: SparkSession, glob: str, wanted: DataFrame | None = None, skip: tuple[str, ...] = ("ns",),
                        batch_rows: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """``pair, src_lang, tgt_lang, line_no, src, tgt`` of the ``{src}-{tgt}.zip`` archives, and ``pair, reason`` of the failed pairs.

    A ``wanted`` pair (``pair, src_lang, tgt_lang``) is read from its archive, or from that of the pair turned round; without a list every
    found pair is wanted and none is skipped. The two members of an archive are first counted and, if they have as many lines as each
    other, then read side by side, so lines are neither joined nor shuffled and nothing of an archive is held but a batch. A packed member
    can only be read from its start: an archive is one task.

    A pair fails without an archive, with several, with one that cannot be unpacked, without a member for a language, or with members of different length;
    nothing of it is read. ``\\n`` or ``\\r\\n`` ends a line. An empty folder of archives gives no rows.
    """
    found = spark.read.format("binaryFile").load(glob).select("path")
    codes = [F.regexp_extract("path", PAIR_ARCHIVE, k) for k in (1, 2)]
    found = found.where(F.col("path").rlike(PAIR_ARCHIVE)).select(F.concat_ws("-", *codes).alias("pair"), codes[0].alias("src_lang"), codes[1].alias("tgt_lang"), "path")
    available = found.groupBy("pair").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("_n"))
    if wanted is None:
        wanted, skip = found.select("pair", "src_lang", "tgt_lang").distinct(), ()
    resolved = resolve_pair_source(wanted, available, skip).join(available.select("path", "_n"), "path", "left")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            reasons = []
            for path, n, *langs in zip(batch["path"], batch["_n"], batch["src_lang"], batch["tgt_lang"]):
                reasons.append(_reason(path, n, langs))
            yield batch[["pair", "src_lang", "tgt_lang", "path"]].assign(reason=reasons)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair, src_lang, tgt_lang, path in zip(batch["pair"], batch["src_lang"], batch["tgt_lang"], batch["path"]):
                # two handles: the members are read in turn, each from its own place
                with _open(path) as one, zipfile.ZipFile(one) as a, _open(path) as two, zipfile.ZipFile(two) as b:
                    with a.open(_member(a, src_lang)) as src, b.open(_member(b, tgt_lang)) as tgt:
                        both, first = zip(_lines(src), _lines(tgt)), 1
                        while rows := list(itertools.islice(both, batch_rows)):
                            yield pd.DataFrame({
                                "pair": pair, "src_lang": src_lang, "tgt_lang": tgt_lang, "line_no": range(first, first + len(rows)),
                                "src": [r[0] for r in rows], "tgt": [r[1] for r in rows]})
                            first += len(rows)

    # one row per pair, written: the second pass must not count again
    spread_out = resolved.select("pair", "src_lang", "tgt_lang", "path", "_n").repartition("pair")
    checked = staged(spread_out.mapInPandas(count, "pair string, src_lang string, tgt_lang string, path string, reason string"), "checked-archives")
    good = checked.where("reason IS NULL").repartition("pair")
    rows = good.mapInPandas(stream, "pair string, src_lang string, tgt_lang string, line_no long, src string, tgt string")
    return rows, checked.where("reason IS NOT NULL").select("pair", "reason")


def _reason(path: str | None, n: float, langs: list[str]) -> str | None:
    """Why an archive cannot be read as a pair, or nothing."""
    if path is None or pd.isna(path):
        return "source missing"
    if n > 1:
        return "several archives"
    try:
        with _open(path) as handle, zipfile.ZipFile(handle) as archive:
            members = [_member(archive, lang) for lang in langs]
            if None in members:
                return "member missing"
            counts = [_line_ends(archive, m) for m in members]
    except (zipfile.BadZipFile, zlib.error, EOFError, pa.ArrowInvalid):
        return "cannot be unpacked"
    return None if counts[0] == counts[1] else "line counts differ"
