"""Uploads: data URIs, magic bytes, path checks, archives with limits."""

from __future__ import annotations

import io
import posixpath
import stat
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Magic bytes by type, and upload limits.
MAGIC = {"FFD8FF": "image/jpeg", "89504E47": "image/png", "25504446": "application/pdf", "504B0304": "application/zip", "47494638": "image/gif", "52494646": "image/webp"}
REFUSED = {"4D5A": "executable", "7F454C46": "executable"}
LIMITS = {"files": 50, "total": 200_000_000, "file": 25_000_000, "ratio": 100, "ratio_from": 1_048_576, "depth": 1}
PDF_PAGES = 20


def data_uri(x: Column) -> Column:
    """struct(mime, bytes) of a base64 or percent-encoded data URI."""
    body, coded = F.regexp_extract(x, r"^data:[^,]*,(.*)$", 1), x.rlike(r"^data:[^,]*;base64,")
    return F.struct(F.regexp_extract(x, r"^data:([^;,]*)", 1).alias("mime"), F.when(coded, F.unbase64(body)).otherwise(F.encode(F.url_decode(body), "UTF-8")).alias("bytes"))


def sniff(content: Column) -> Column:
    """struct(mime, safe, reason) by the bytes alone: magic first, then text."""
    head = F.hex(F.substring(content, 1, 8))
    told = lambda mime, why: F.struct((F.lit(mime) if mime else F.lit(None).cast("string")).alias("mime"), F.lit(bool(mime)).alias("safe"), F.lit(why).alias("reason"))
    out = F
    for magic, why in REFUSED.items():
        out = out.when(head.startswith(magic), told(None, why))
    for magic, mime in MAGIC.items():
        out = out.when(head.startswith(magic), told(mime, ""))
    is_text = F.is_valid_utf8(content.cast("string")) & ~content.cast("string").rlike(r"[\x00-\x08\x0E-\x1F]")
    return out.when(F.coalesce(is_text, F.lit(False)), told("text/plain", "")).otherwise(told(None, "unsupported_type"))


def kind_of(content: bytes) -> tuple[str, str]:
    """(mime, reason) of bytes, as sniff() has it."""
    head = content[:8].hex().upper()
    for magic, why in REFUSED.items():
        if head.startswith(magic):
            return "", why
    for magic, mime in MAGIC.items():
        if head.startswith(magic):
            return mime, ""
    try:
        bad = any(c < 9 or 13 < c < 32 for c in content.decode("utf-8").encode("latin-1", "replace"))
    except UnicodeDecodeError:
        bad = True
    return ("", "unsupported_type") if bad else ("text/plain", "")


def unsafe_path(name: str) -> str:
    """Why a path in an archive is refused, or ''."""
    if "\0" in name:
        return "null_byte_in_path"
    name = name.replace("\\", "/")
    if name.startswith("/") or name[1:2] == ":":
        return "absolute_path"
    return "path_traversal" if posixpath.normpath(name).startswith("..") or ".." in name.split("/") else ""


def ignorable(name: str) -> bool:
    base = posixpath.basename(name)
    return name.endswith("/") or name.startswith("__MACOSX/") or base.startswith("._") or base in (".DS_Store", "Thumbs.db")


def entries(content: bytes, limits: dict = LIMITS) -> Iterator[tuple[str, bytes | None, str]]:
    """(path, bytes, reason) of an archive; reason '' means accepted. Nothing is written to disk."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        yield "", None, "not_an_archive"
        return
    infos, total, files = archive.infolist(), 0, 0
    if len(infos) > 4 * limits["files"]:
        yield "", None, "too_many_entries"
        return
    for e in infos:
        if ignorable(e.filename):
            continue
        why = unsafe_path(e.filename)
        why = why or ("symlink" if stat.S_IFMT(e.external_attr >> 16) == stat.S_IFLNK else "")
        why = why or ("file_too_large" if e.file_size > limits["file"] else "")
        why = why or ("compression_ratio" if e.file_size > limits["ratio_from"] and e.file_size > limits["ratio"] * max(e.compress_size, 1) else "")
        if not why and (total + e.file_size > limits["total"] or files + 1 > limits["files"]):
            yield e.filename, None, "limit_reached"
            return
        data = None if why else archive.read(e)
        if data is not None and data[:4] == b"PK\x03\x04":
            why, data = "nested_archive", None
        if data is not None:
            why = kind_of(data)[1] and "unsupported_type"
            total, files = total + len(data), files + 1
        yield e.filename, data if not why else None, why


def expand(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, entry, content, reason): archives opened, accepted and refused entries alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(p, *x) for x in entries(bytes(c))], columns=["path", "entry", "content", "reason"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "path string, entry string, content binary, reason string")


#: Rows of a frame, and bytes of content that end one earlier.
FRAME_ROWS, FRAME_BYTES = 10_000, 32_000_000


def framed(rows: Iterator[tuple], columns: list[str], size: Callable[[tuple], int]) -> Iterator[pd.DataFrame]:
    """Rows in frames of FRAME_ROWS at most, or of those that FRAME_BYTES are reached with: a frame of its own for each costs more than its row."""
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += size(r)
        if len(held) >= FRAME_ROWS or weight >= FRAME_BYTES:
            yield pd.DataFrame(held, columns=columns)
            held, weight = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


FOUND = "upload_id long, ord long, name string, entry string, page int, mime string, bytes long, content binary, reason string"


def discover(inputs: DataFrame, limits: dict = LIMITS, pages: Callable[[bytes], list[bytes]] | None = None) -> DataFrame:
    """FOUND: the files of each upload, accepted (reason '') and refused, from ``inputs`` (upload_id, ord, name, content).

    Archives are opened, and the pages of a PDF are files of their own if ``pages`` renders them. Limits run over all files of
    an upload in order: one that is too much is refused and later ones may still fit, but an archive or a PDF ends there.
    An upload's inputs are streamed one after another.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upload, total, files = None, 0, 0

        def room(data: bytes) -> str:
            nonlocal total, files
            if files >= limits["files"]:
                return "max_files"
            if total + len(data) > limits["total"]:
                return "max_total_bytes"
            total, files = total + len(data), files + 1
            return ""

        def rendered(entry: str, data: bytes) -> Iterator[tuple]:
            if pages is None:
                yield entry, 0, "application/pdf", None, "pdf_not_rendered"
                return
            for n, image in enumerate(pages(data)[:PDF_PAGES], 1):
                why = room(image)
                yield f"{entry}#page={n}", n, "image/jpeg", None if why else image, why
                if why:
                    return

        def found(name: str, data: bytes) -> Iterator[tuple]:
            mime, why = kind_of(data)
            if not data or len(data) > limits["file"] or why:
                yield "", 0, mime, None, "empty_file" if not data else "file_too_large" if len(data) > limits["file"] else why
            elif mime == "application/zip":
                for entry, inner, refused in entries(data, limits):
                    kind = kind_of(inner)[0] if inner is not None else ""
                    if inner is None:
                        yield entry, 0, "", None, refused
                    elif kind == "application/pdf":
                        yield from rendered(entry, inner)
                    else:
                        why = room(inner)
                        yield entry, 1, kind, None if why else inner, why
                        if why:
                            return
            elif mime == "application/pdf":
                yield from rendered(name, data)
            else:
                why = room(data)
                yield "", 1, mime, None if why else data, why

        def rows() -> Iterator[tuple]:
            nonlocal upload, total, files
            for pdf in batches:
                for r in pdf.itertuples():
                    if r.upload_id != upload:
                        upload, total, files = r.upload_id, 0, 0
                    data = bytes(r.content) if r.content is not None else b""
                    for e, p, m, d, why in found(r.name, data):
                        yield r.upload_id, r.ord, r.name, e, p, m or None, len(d) if d is not None else len(data), d, why

        yield from framed(rows(), [c.split()[0] for c in FOUND.split(", ")], lambda r: len(r[7] or b""))

    return inputs.select("upload_id", "ord", "name", "content").repartition("upload_id").sortWithinPartitions("upload_id", "ord").mapInPandas(run, FOUND)
