"""A cache of fetched sequences as a Spark data source: spark.read.format("sequence_cache").

Payloads are FASTA texts, `<accession>.fasta` in one folder that driver and executors share. A read makes one
partition an accession, up to `partitions`, beyond which accessions are dealt out evenly: tasks read their
payloads, and with `email` or a `url` of their own fetch what the cache lacks and store it. A row is one
accession with the provenance of its payload, whether or not it was found; what a user keeps of that is written
by Spark like any other table. Writing (`df.write.format("sequence_cache")`) stores name, accession and sequence
of every row as payloads.

Options: `path` (folder, any file system that pyarrow.fs knows); `accessions` (comma-separated; all payloads of
the folder if absent); `partitions`; `email`, `api_key`, `url` (a template with {accession}, {email} and
{api_key}); `retries`, `backoff` and `pause` in seconds. A service's rate limit holds for all tasks together:
choose `partitions` by it.

A payload is written under a name of its own and then moved to its place, so a reader or a lost task never leaves
half a payload, and two tasks that fetch the same accession end with one. Accessions may not hold a slash."""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Iterator
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

EFETCH = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi"
ENTREZ = EFETCH + "?db=nucleotide&id={accession}&rettype=fasta&retmode=text&email={email}&api_key={api_key}"
SCHEMA = (
    "accession string, name string, sequence string, raw_length long, length_bp long, retained_pct double, sha256 string, "
    "cache_path string, downloaded_this_run boolean, attempts int, timestamp_utc string, source string, error string"
)
LINE = 70


class Folder:
    """The payloads of a cache."""

    def __init__(self, path: str):
        from pyarrow import fs

        if not path:
            raise ValueError("the option `path` names the cache's folder")
        if path.startswith("file:"):
            self.fs, self.root = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        else:
            self.fs, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")

    def place(self, accession: str) -> str:
        if "/" in accession or not accession:
            raise ValueError(f"not an accession: {accession!r}")
        return f"{self.root}/{accession}.fasta"

    def names(self) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return sorted(f.base_name.removesuffix(".fasta") for f in found if f.is_file and f.base_name.endswith(".fasta") and not f.base_name.startswith("."))

    def read(self, accession: str) -> str | None:
        try:
            with self.fs.open_input_stream(self.place(accession), compression=None) as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def write(self, accession: str, text: str) -> None:
        self.fs.create_dir(self.root, recursive=True)
        own = f"{self.root}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(own, compression=None) as f:
            f.write(text.encode())
        self.fs.move(own, self.place(accession))


def fetched(url: str, retries: int, backoff: float, sleep=time.sleep) -> tuple[str | None, int, str | None]:
    """A FASTA text, or None; how many times it was asked for; and what the last failure was."""
    said = None
    for attempt in range(1, max(1, retries) + 1):
        try:
            with urlopen(url, timeout=60) as answer:
                text = answer.read().decode()
            if text.startswith(">"):
                return text, attempt, None
            said = "no FASTA text"
        except (OSError, ValueError) as e:
            said = f"{type(e).__name__}: {e}"
        if attempt < retries:
            sleep(backoff * attempt)
    return None, max(1, retries), said


def row_of(accession: str, text: str | None, place: str, fresh: bool, attempts: int, error: str | None, source: str) -> tuple:
    now = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    if text is None:
        return (accession, None, None, None, None, None, None, place, False, attempts, now, source, error or "not in the cache")
    lines = [x.strip() for x in text.splitlines()]
    raw = "".join(x for x in lines if not x.startswith(">"))
    plain = re.sub("[^ACGT]", "", raw.upper().replace("U", "T"))
    name = next((x[1:].strip() for x in lines if x.startswith(">")), "") or accession
    return (accession, name, plain, len(raw), len(plain), 100.0 * len(plain) / max(1, len(raw)), hashlib.sha256(plain.encode()).hexdigest(), place, fresh, attempts, now, source, None)


class Asked(InputPartition):
    def __init__(self, accessions: list[str]):
        super().__init__(accessions)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.listed = [x.strip() for x in options.get("accessions", "").split(",") if x.strip()]
        self.all = "accessions" not in options
        self.most = int(options.get("partitions", 1000))
        self.email, self.key = options.get("email", ""), options.get("api_key", "")
        self.url = options.get("url") or (ENTREZ if self.email else "")
        self.retries, self.backoff, self.pause = int(options.get("retries", 3)), float(options.get("backoff", 1.5)), float(options.get("pause", 0.35))

    def partitions(self) -> list[InputPartition]:
        asked = Folder(self.path).names() if self.all else sorted(set(self.listed))
        n = max(1, min(len(asked), self.most))
        return [Asked(asked[k::n]) for k in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        folder = Folder(self.path)
        source = self.url.split("?")[0] or "cache"
        for accession in partition.value:
            text, attempts, error = folder.read(accession), 0, None
            fresh = text is None and bool(self.url)
            if fresh:
                url = self.url.format(accession=quote(accession), email=quote(self.email), api_key=quote(self.key))
                text, attempts, error = fetched(url, self.retries, self.backoff)
                if text is not None:
                    folder.write(accession, text)
                time.sleep(self.pause)
            yield row_of(accession, text, folder.place(accession), fresh, attempts, error, source)


class Writer(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.path = options.get("path", "")
        self.at = [columns.index(c) for c in ("accession", "name", "sequence")]

    def write(self, iterator) -> WriterCommitMessage:
        folder = Folder(self.path)
        for row in iterator:
            accession, name, sequence = (row[k] for k in self.at)
            body = sequence or ""
            folder.write(accession, "\n".join([f">{name or accession}", *(body[k : k + LINE] for k in range(0, len(body), LINE)), ""]))
        return WriterCommitMessage()


class SequenceCache(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sequence_cache"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a cache is added to: use mode('append'); a payload of the same accession is replaced")
        return Writer(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(SequenceCache)
