"""Readers of mirrors, indexes and cached files, and the fallback between two sources."""

from __future__ import annotations

import json
import logging
import time
from pathlib import Path
from urllib.parse import parse_qs, urljoin, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from specloom.operators.rules import Excludes

log = logging.getLogger(__name__)

#: fixed values: file names of experimental machines
SKIP_PREFIXES = ("Acid", "Boosted_", "WIP_", "ColecoVision", "Sega_")
RETRY_STATUS, RETRIES, RETRY_WAIT, TIMEOUT = (502, 503), 5, 2.0, 30
BLOBS = "file_name string, content binary"


def mirror(spark: SparkSession, folder: str, pattern: str = "*.xml", excludes: Excludes | None = None, skip_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(file_name, content) of a folder's files. Names are filtered before contents are read. A missing folder is empty."""
    if not Path(folder).is_dir():
        log.error("no such mirror: %s", folder)
        return spark.createDataFrame([], BLOBS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    named = files.withColumn("file_name", F.url_decode(F.replace(F.substring_index("path", "/", -1), F.lit("+"), F.lit("%2B"))))
    return (excludes or Excludes([])).keep_files(named, "file_name", skip_prefixes).select("file_name", "content")


def rom_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of all files below a folder, paths relative to it. A missing folder is empty."""
    if not Path(folder).is_dir():
        log.error("no such folder: %s", folder)
        return spark.createDataFrame([], "path string, length long, content binary")
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    full = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    return got.select(F.substring(full, F.lit(len(str(Path(folder).resolve())) + 2), F.length(full)).alias("path"), "length", "content")


def with_fallback(listing: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Contents of `listing` (file_name) from the first source, where it has none from the second."""
    a, b = first.withColumnRenamed("content", "_a"), second.withColumnRenamed("content", "_b")
    return listing.join(a, "file_name", "left").join(b, "file_name", "left").select("file_name", F.coalesce("_a", "_b").alias("content"))


def mirrored_page(url: str, page: int = 1, suffix: str = ".html") -> str:
    """File name of a mirrored page; further pages of a category carry their number."""
    from urllib.parse import unquote

    slug = unquote(url.partition("/wiki/")[2].partition("?")[0]).replace("_", " ").translate(str.maketrans(":/", "__"))
    return f"{slug}_page{page}{suffix}" if page > 1 else slug + suffix


def next_page(links: list[tuple[str, str]], base: str) -> str | None:
    """Address of the next page of a category from its (address, text) links; the older form is brought to the newer."""
    for href, text in links:
        if "from=" not in href or "next" not in text.lower():
            continue
        full = urljoin(base, href)
        query = parse_qs(urlparse(full).query)
        if "index.php" in full and "title" in query:
            start = query.get("from", [""])[0]
            return f"{base.rstrip('/')}/wiki/{query['title'][0]}" + (f"?pagefrom={start}" if start else "")
        return full
    return None


def fetch(url: str, opener=None, wait: float = RETRY_WAIT, retries: int = RETRIES) -> bytes:
    """GET with retries on gateway errors only; other errors are raised at once."""
    from urllib.error import HTTPError
    from urllib.request import urlopen

    get = opener or (lambda u: urlopen(u, timeout=TIMEOUT).read())  # noqa: S310
    for k in range(retries + 1):
        try:
            return get(url)
        except HTTPError as e:
            if e.code not in RETRY_STATUS or k == retries:
                raise
            time.sleep(wait)
    raise AssertionError


class _Page(InputPartition):
    def __init__(self, name: str, url: str):
        self.name, self.url = name, url


class _WebReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options.get("urls", "{}"))
        self.delay = float(options.get("delay", "0"))
        self.retries = int(options.get("retries", str(RETRIES)))

    def partitions(self) -> list[InputPartition]:
        return [_Page(n, u) for n, u in self.urls.items()] or [_Page("", "")]

    def read(self, part: _Page):
        if not part.url:
            return
        time.sleep(self.delay)
        try:
            yield part.name, fetch(part.url, retries=self.retries)
        except OSError as e:
            log.warning("%s: %s", part.url, e)
            yield part.name, None


class WebFiles(DataSource):
    """`spark.read.format("specloom_web").option("urls", json of {name: address})`: one partition per file; a file that
    can't be had is null."""

    @classmethod
    def name(cls) -> str:
        return "specloom_web"

    def schema(self) -> str:
        return BLOBS

    def reader(self, schema) -> DataSourceReader:
        return _WebReader(self.options)


def records(spark: SparkSession, path: str, schema: str, required: bool = True) -> DataFrame:
    """A cached JSON array of records. Missing: an error, or empty where it isn't required; no array: ValueError."""
    if not Path(path).exists():
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    with open(path, encoding="utf-8") as f:
        head = f.read(4096).lstrip("﻿ \t\r\n")
    if not head.startswith("["):
        raise ValueError(f"{path} is no JSON array")
    return spark.read.schema(schema).option("multiLine", True).json(path)


def sha1_index(spark: SparkSession, path: str) -> DataFrame:
    """(sha1, path) of a text index 'sha1 ./relative/path'; lines of another form are left out."""
    lines = spark.read.text(path)
    return lines.select(F.lower(F.regexp_extract("value", r"^\s*(\S+)\s+(.+?)\s*$", 1)).alias("sha1"), F.regexp_replace(F.regexp_extract("value", r"^\s*(\S+)\s+(.+?)\s*$", 2), r"^[./]+", "").alias("path")).where("sha1 <> '' and path <> ''")


def first_file(sha1s: DataFrame, index: DataFrame, files: DataFrame, key: tuple[str, ...] = ("doc", "doc_ord")) -> DataFrame:
    """(key, path, length): of the hashes a device lists the first whose file exists. `files`: (path, length)."""
    each = sha1s.where(F.size("sha1s") > 0).select(*key, F.posexplode("sha1s").alias("pos", "sha1"))
    return each.join(index, "sha1").join(files, "path").groupBy(*key).agg(F.min_by("path", "pos").alias("path"), F.min_by("length", "pos").alias("length"))


def rom_bytes(roms: DataFrame, content: str = "content", offset: str = "offset") -> DataFrame:
    """Adds character_set and keyboard_type: lower nibbles of bytes 0x2B and 0x2C behind `offset`; null beyond the end."""
    from specloom.functions.text import low_nibble
    from specloom.sources.machines import CHARACTER_SETS, KEYBOARD_TYPES

    byte = lambda at: F.when(F.length(content) > F.col(offset) + at, F.conv(F.hex(F.substring(F.col(content), F.col(offset).cast("int") + at + 1, F.lit(1))), 16, 10).cast("int"))
    return roms.withColumn("character_set", low_nibble(byte(0x2B), CHARACTER_SETS)).withColumn("keyboard_type", low_nibble(byte(0x2C), KEYBOARD_TYPES))


def himem(spark: SparkSession, path: str) -> DataFrame:
    """(name, himem_addr) of a text of 'Name - 0xADDR' lines."""
    lines = spark.read.text(path)
    return lines.select(F.regexp_extract("value", r"^(.*) - (0x[0-9A-Fa-f]+)\s*$", 1).alias("name"), F.regexp_extract("value", r"^(.*) - (0x[0-9A-Fa-f]+)\s*$", 2).alias("himem_addr")).where("himem_addr <> ''")


def config(path: str | Path) -> dict:
    """Settings; a missing or malformed file is empty."""
    try:
        got = json.loads(Path(path).read_text(encoding="utf-8"))
        return got if isinstance(got, dict) else {}
    except (OSError, json.JSONDecodeError):
        return {}


def symbols(path: str | Path) -> dict[str, str]:
    own = config(path).get("slotmap_symbols", {})
    return {k: str(own.get(k, v)) for k, v in {"absent": "⌧", "empty_page": "⌴", "mirror_suffix": "*", "subslot_suffix": "!"}.items()}
