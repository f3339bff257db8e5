"""Sequence records: FASTA files, metadata tables, the accession catalogue and an offline fetch cache."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.symbols import clean, organism_type, retained_pct
from strandline.sources import fasta

RECORD = "name string, accession string, organism_type string, sequence string, raw_length long, metadata map<string,string>"

# Names and accessions by tier; a later tier overrides an earlier one by name.
TIERS = {
    "core": {"phiX174": "NC_001422", "pUC19": "L09137", "SARS-CoV-2": "NC_045512", "M13": "NC_003287", "pBR322": "J01749", "SV40": "NC_001669", "Lambda": "NC_001416", "PSTVd": "NC_002030", "Human_mtDNA": "NC_012920", "T7_phage": "NC_001604", "MS2_phage": "NC_001417"},
    "full": {"E_coli_K12": "NC_000913", "B_subtilis": "NC_000964"},
    "extra": {"P_aeruginosa_PA_O1": "NC_002516", "M_tuberculosis_H37Rv": "NC_000962", "V_cholerae_chr1": "NC_002505", "S_pneumoniae_R6": "NC_003098", "H_influenzae_RdKW20": "NC_000907", "M_jannaschii": "NC_000916", "T_thermophilus": "NC_006461", "S_cerevisiae_chrIV": "NC_001136"},
    "ultra": {"Salmonella_enterica": "NC_003197", "Streptomyces_coelicolor": "NC_005363", "Pseudomonas_putida": "NC_009512", "Bacillus_cereus": "NC_003909", "Rhodobacter_sphaeroides": "NC_007779", "Sulfolobus_solfataricus": "NC_002754", "Arabidopsis_chr1": "NC_003070", "Drosophila_chr4": "NC_004353", "C_elegans_chrI": "NC_003279", "S_cerevisiae_full": "NC_001143", "Human_chr1": "NC_000001", "Human_chr2": "NC_000002", "Human_chr19": "NC_000019", "Human_chr21": "NC_000021"},
    "diverse": {"Arabidopsis_chr2": "NC_003071", "Arabidopsis_chr3": "NC_003074", "Arabidopsis_chr4": "NC_003075", "Arabidopsis_chr5": "NC_003076", "C_elegans_chrII": "NC_003280", "C_elegans_chrIII": "NC_003281", "C_elegans_chrIV": "NC_003282", "C_elegans_chrV": "NC_003283", "C_elegans_chrX": "NC_003284", "Drosophila_chrX": "NC_004354", "Human_chr22": "NC_000022", "Human_chrX": "NC_000023"},
}
LEVELS = {"core": ("core",), "full": ("core", "full"), "extra": ("core", "full", "extra"), "ultra": ("core", "full", "extra", "ultra"), "mega": tuple(TIERS)}

# The twelve repeats of the toy corpus, 105,000 symbols in all when joined.
TOY = (
    ("phiX174", "GAGTTTTATCGCTTCCATGACGCAGAAGTTAACACTTTCGGATATTTCTGATGAGTCGAAAAATTATCTT", 80),
    ("pUC19", "GCGCGTAATCTGCTGCTTGCAAACAAAAAAACCACCGCTACCAGCGGTGGTTTGTTTGCCGGATCAAGAG", 40),
    ("SARS-CoV-2", "ATTAAAGGTTTATACCTTCCCAGGTAACAAACCAACCAACTTTCGATCTCTTGTAGATCTGTTCTCTAAA", 370),
    ("M13", "GTAATACGACGGCCAGTGAATTCGAGCTCGGTACCCGGGGATCCTCTAGAGTCGACCTGCAGGCATGCAA", 80),
    ("pBR322", "GAATTCGAGCTCGGTACCCGGGGATCCTCTAGAGTCGACCTGCAGGCATGCAAGCTTGGCGTAATCATGG", 55),
    ("SV40", "GCTTTGCATGCCTGCAGGTCTAGCTAGCTAGCTAGCTAGCTAGCTAGCTAGCTAGCTAGCTAGCTAGC", 80),
    ("Lambda", "GCGCGTAATCTGCTGCTTGCAAACAAAAAAACCACCGCTACCAGCGGTGGTTTGTTTGCCGGATCAAGAG", 600),
    ("PSTVd", "GCGCGTAATCTGCTGCTTGCAAACAAAAAAACCACCGCTACCAGCGGTGGTTTGTTTGCCGGATCAAGAG", 5),
    ("Human_mtDNA", "ATTAACCCTCACTAAAGGGAGACCGTATAGTGAGTCGTATTA", 15),
    ("T7_phage", "TAATACGACTCACTATAGGGAGACCGTATAGTGAGTCGTATTA", 120),
    ("MS2_phage", "GCGCGTAATCTGCTGCTTGCAAACAAAAAAACCACCGCTACCAGCGGTGGTTTGTTTGCCGGATCAAGAG", 80),
    ("Synthetic", "ATGCATGCATGCATGCATGCATGCATGCATGCATGCATGCATGCATGCATGCATGCATGCATGCATGCA", 30),
)
EFETCH = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi"


def catalog(spark: SparkSession, level: str = "core") -> DataFrame:
    """name, accession, tier, organism_type of all tiers up to a level; the last entry of a name stays."""
    rows = [(n, a, t) for t, tier in enumerate(LEVELS[level]) for n, a in TIERS[tier].items()]
    df = spark.createDataFrame(rows, "name string, accession string, tier int")
    last = Window.partitionBy("name").orderBy(F.desc("tier"))
    df = df.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")
    return df.withColumn("organism_type", organism_type(F.col("name")))


def toy(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(TOY, "name string, unit string, times int")
    return df.select("name", F.expr("repeat(unit, times)").alias("sequence"))


def read_fasta(spark: SparkSession, path: str | list[str], split_records: bool = False, keep_symbols: bool = False) -> DataFrame:
    """Records of FASTA files of any size, gzip by suffix. All records of a file make one, named by its first
    header; `split_records` keeps them apart. `keep_symbols` skips the cleaning, except for case and U."""
    return fasta.records(spark, path, split_records, keep_symbols)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """key, meta: every row of a CSV with header under its path, name, accession, base name and stem;
    empty cells are dropped and the last row of a key wins."""
    raw = spark.read.csv(path, header=True)
    cells = F.map_filter(F.create_map(*[x for c in raw.columns for x in (F.lit(c), F.trim(F.col(c)))]), lambda _, v: v.isNotNull() & (v != ""))
    rows = raw.select(cells.alias("meta"), F.monotonically_increasing_id().alias("line"))
    base = F.element_at(F.split(F.col("meta")["path"], "/"), -1)
    keys = F.array_distinct(F.array_compact(F.array(F.col("meta")["path"], F.col("meta")["name"], F.col("meta")["accession"], base, F.regexp_replace(base, r"\.[^.]*$", ""))))
    return rows.select(F.explode(keys).alias("key"), "meta", "line").groupBy("key").agg(F.max_by("meta", "line").alias("meta"))


def apply_metadata(records: DataFrame, meta: DataFrame) -> DataFrame:
    """The first hit of name, accession, base name and stem overrides name and type and is attached."""
    base = F.element_at(F.split("accession", "/"), -1)
    tries = F.array_compact(F.array(F.col("name"), F.col("accession"), base, F.regexp_replace(base, r"\.[^.]*$", "")))
    r = records.drop("metadata").withColumn("_row", F.xxhash64("name", "accession", "sequence"))
    hits = r.select("_row", F.posexplode(tries).alias("at", "key")).join(meta, "key").groupBy("_row").agg(F.min_by("meta", "at").alias("m"))
    out = r.join(hits, "_row", "left")
    m = F.coalesce("m", F.create_map().cast("map<string,string>"))
    return out.select(F.coalesce(m["name"], F.col("name")).alias("name"), F.coalesce(m["accession"], F.col("accession")).alias("accession"), organism_type(F.coalesce(m["name"], F.col("name")), F.coalesce(m["organism_type"], F.when(F.col("organism_type") != "unknown", F.col("organism_type")))).alias("organism_type"), "sequence", "raw_length", m.alias("metadata"))


def load_records(spark: SparkSession, frames: list[DataFrame], metadata: DataFrame | None = None) -> DataFrame:
    """All sources together, without empty sequences."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    if metadata is not None:
        out = apply_metadata(out, metadata)
    return out.where(F.length("sequence") > 0)


def manifest(records: DataFrame) -> DataFrame:
    n = F.length("sequence")
    return records.select("name", "accession", "organism_type", n.cast("long").alias("length_bp"), "raw_length", retained_pct(n, F.col("raw_length")).alias("retained_pct"), F.sha2("sequence", 256).alias("sha256"))


def entrez(email: str, api_key: str = "", timeout: float = 60.0) -> Callable[[str], str]:
    """A fetcher of nucleotide records as FASTA text."""
    from urllib.parse import urlencode
    from urllib.request import urlopen

    def fetch(accession: str) -> str:
        asked = {"db": "nucleotide", "id": accession, "rettype": "fasta", "retmode": "text", "email": email} | ({"api_key": api_key} if api_key else {})
        with urlopen(f"{EFETCH}?{urlencode(asked)}", timeout=timeout) as answer:
            return answer.read().decode()

    return fetch


class FetchCache:
    """FASTA payloads by accession in a folder of the driver, with provenance in one JSON file. A fetcher is
    used only where the cache has no entry; without one nothing is fetched."""

    def __init__(self, folder, fetch: Callable[[str], str] | None = None, retries: int = 3, backoff: float = 1.5, pause: float = 0.35, sleep=time.sleep):
        self.folder, self.fetch, self.retries, self.backoff, self.pause, self.sleep = Path(folder), fetch, retries, backoff, pause, sleep
        self.folder.mkdir(parents=True, exist_ok=True)
        self.meta = self.folder / "fetch_metadata.json"

    def records(self) -> dict:
        try:
            return json.loads(self.meta.read_text()).get("records", {})
        except (OSError, ValueError, AttributeError):
            return {}

    def _download(self, accession: str) -> str | None:
        for attempt in range(1, max(1, self.retries) + 1):
            try:
                text = self.fetch(accession)
                if text.startswith(">"):
                    return text
            except Exception:  # whatever the fetcher meets counts as a failed attempt
                pass
            self.sleep(self.backoff * attempt)
        return None

    def path(self, name: str, accession: str):
        """Place of the payload, or None if it is neither cached nor fetched."""
        place = self.folder / f"{accession}.fasta"
        fresh = not place.exists()
        if fresh:
            text = self._download(accession) if self.fetch else None
            if text is None:
                return None
            place.write_text(text)
            self.sleep(self.pause)
        raw = "".join(line.strip() for line in place.read_text().splitlines() if not line.startswith(">"))
        plain = re.sub("[^ACGT]", "", raw.upper().replace("U", "T"))
        told = {
            "name": name, "accession": accession, "cache_path": str(place), "downloaded_this_run": fresh, "timestamp_utc": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "length_bp": len(plain),
            "raw_length_bp": len(raw), "retained_pct": 100.0 * len(plain) / max(1, len(raw)), "sha256": hashlib.sha256(plain.encode()).hexdigest(), "source": "NCBI nucleotide efetch FASTA",
        }
        self.meta.write_text(json.dumps({"records": self.records() | {accession: told}}, indent=2, sort_keys=True))
        return place


def sequences_from_documents(docs: DataFrame, block: int = 2000) -> DataFrame:
    """Records of a text table: the cleaned texts of up to `block` consecutive identifiers of a language
    and source, in order. A record is bounded, and their number follows the table."""
    part = F.floor(F.col("doc_id") / block).cast("string")
    rows = docs.select(F.concat_ws("_", "lang", "source", part).alias("name"), F.col("source").alias("accession"), F.col("lang").alias("organism_type"), "doc_id", clean(F.col("text")).alias("s"), F.length("text").alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "s"))), lambda x: x["s"]), "")
    got = rows.groupBy("name", "accession", "organism_type").agg(joined.alias("sequence"), F.sum("n").alias("raw_length"))
    return got.where(F.length("sequence") > 0)
