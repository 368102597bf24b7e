"""Reading a mail archive: a recursive scan of message files, or tar archives of them, into the typed table.

Files are read by ``binaryFile`` in parallel; a message is parsed in Arrow batches.  Defined results: a file without a Message-ID, or one that
cannot be parsed, gives no row; of several files with one id the smallest path stays (:func:`first_path`); a missing or broken date is null; an empty archive gives no rows.
"""

from __future__ import annotations

import re
import tarfile
from collections.abc import Iterator
from datetime import timezone
from email import message_from_bytes, policy
from email.utils import getaddresses, parsedate_to_datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill import schema
from lettermill.functions.text import PARSER_CUT, PREFIXES

_PREFIXES = re.compile(PREFIXES, re.I)
_CUT = re.compile(PARSER_CUT, re.M)
_ARROW = pa.schema(
    [("message_id", pa.string()), ("from_addr", pa.string()), *((c, pa.list_(pa.string())) for c in ("to_addrs", "cc_addrs", "bcc_addrs")), ("subject", pa.string()), ("normalized_subject", pa.string()),
     ("date", pa.timestamp("us")), ("in_reply_to", pa.string()), ("references", pa.list_(pa.string())), ("body", pa.string()), ("word_count", pa.int64()), ("file_path", pa.string())]
)


def _addresses(value) -> list[str]:
    """The addresses of a header in small letters, by the library's reading of names, groups and quoted commas; an entry without an address counts by its text."""
    pairs = getaddresses([" ".join(str(value or "").split())], strict=False)
    return [x for name, addr in pairs if (x := (addr or name).strip().lower())]


def _text(msg) -> str:
    parts = []
    for part in msg.walk():
        if part.get_content_type() == "text/plain" and not part.is_multipart():
            raw = part.get_payload(decode=True) or b""
            try:
                parts.append(raw.decode(part.get_content_charset() or "utf-8", "replace"))
            except LookupError:
                parts.append(raw.decode("latin-1"))
    return "\n".join(parts).replace("\r\n", "\n")


def parse_message(raw: bytes, path: str) -> dict | None:
    """One row of the table from the bytes of a message, or nothing."""
    try:
        msg = message_from_bytes(raw, policy=policy.compat32)
        mid = str(msg.get("Message-ID") or "").strip().strip("<>").lower()
        if not mid:
            return None
        body = _text(msg)
        cut = _CUT.search(body)
        body = (body[: cut.start()] if cut else body).strip()
        try:
            when = parsedate_to_datetime(str(msg.get("Date")))
            when = when.astimezone(timezone.utc).replace(tzinfo=None) if when.tzinfo else when
        except (TypeError, ValueError):
            when = None
        subject = re.sub(r"\r?\n[ \t]*", " ", str(msg.get("Subject") or "")).strip()
        refs = str(msg.get("References") or "").split()
        return {
            "message_id": mid, "from_addr": " ".join(str(msg.get("From") or "").split()).lower(), "to_addrs": _addresses(msg.get("To")), "cc_addrs": _addresses(msg.get("Cc")), "bcc_addrs": _addresses(msg.get("Bcc")),
            "subject": subject, "normalized_subject": _PREFIXES.sub("", subject).strip().lower(), "date": when, "in_reply_to": str(msg.get("In-Reply-To") or "").strip() or None,
            "references": refs, "body": body, "word_count": len(body.split()), "file_path": path,
        }
    except Exception:  # noqa: BLE001 - a broken file must not end the scan
        return None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [r for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (r := parse_message(c, p))]
        yield from pa.Table.from_pylist(rows, schema=_ARROW).to_batches()


def read_archive(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """All messages under ``folder``. Wanted ids can be filtered on the result; the header is at the front, so :func:`wanted` skips full parses."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return parse_files(files.select("path", "content"))


def parse_files(files: DataFrame) -> DataFrame:
    """Rows (path, content) parsed into the typed table."""
    return files.mapInArrow(_parse, schema.PARSED_EMAILS)


def wanted(files: DataFrame, ids: DataFrame) -> DataFrame:
    """Files whose Message-ID, looked for in the first 8 KB, is one of ``ids.message_id``; so only these are parsed."""
    head = F.decode(F.substring("content", 1, 8192), "ISO-8859-1")
    mid = F.lower(F.regexp_extract(head, r"(?im)^message-id:\s*<?([^<>\s]+)>?", 1))
    return files.withColumn("message_id", mid).join(ids.select("message_id").distinct(), "message_id", "left_semi").drop("message_id")


def first_path(parsed: DataFrame) -> DataFrame:
    """One row an id: that of the smallest path."""
    rest = [c for c in parsed.columns if c not in ("message_id", "file_path")]
    return parsed.groupBy("message_id").agg(F.min_by(F.struct("file_path", *rest), "file_path").alias("r")).select("message_id", "r.*").select(*parsed.columns)


def complete(parsed: DataFrame, ids: DataFrame) -> DataFrame:
    """``parsed``; raises if an id is missing."""
    missing = ids.select("message_id").distinct().join(parsed, "message_id", "left_anti").limit(5).collect()
    if missing:
        raise LookupError(f"ids not in the archive: {[r[0] for r in missing]}")
    return parsed


def unpack_tar(path: str, target: str) -> int:
    """Unpacks the regular files of a tar archive under ``target`` for :func:`read_archive`; members that would leave the folder are refused."""
    root = Path(target).resolve()
    n = 0
    with tarfile.open(path) as tar:
        for m in tar:
            to = (root / m.name).resolve()
            if m.isfile() and root in to.parents:
                to.parent.mkdir(parents=True, exist_ok=True)
                to.write_bytes(tar.extractfile(m).read())
                n += 1
    return n
