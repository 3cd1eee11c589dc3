"""Live sources and which source is read: live only, live with a mirror behind it, or a mirror only.

Listings are a handful of requests in a row and are made by the driver; files are fetched by `WebFiles`, one task each.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from specloom.operators.rules import Excludes
from specloom.sources import files, pages

log = logging.getLogger(__name__)

#: fixed value: listing of machine descriptions in the emulator's repository
MACHINES_API = "https://api.github.com/repos/openMSX/openMSX/contents/share/machines"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(files.WebFiles)


def contents_listing(body: bytes | str, excludes: Excludes | None = None, skip_prefixes: tuple[str, ...] = files.SKIP_PREFIXES) -> dict[str, str]:
    """{file name: address} of the XML files of a folder listing, in its order, without excluded and experimental ones."""
    items = [(x["name"], x.get("download_url")) for x in json.loads(body) if x.get("type") == "file" and x["name"].endswith(".xml")]
    out = (excludes or Excludes([])).wanted_files([n for n, _ in items], skip_prefixes)
    return {n: u for n, u in items if n in out and u}


def web_files(spark: SparkSession, urls: dict[str, str], delay: float = 0.0, retries: int = files.RETRIES) -> DataFrame:
    """(file_name, content) of addresses; content is null where a file can't be had."""
    register(spark)
    return spark.read.format("specloom_web").option("urls", json.dumps(urls)).option("delay", str(delay)).option("retries", str(retries)).load()


def descriptions(spark: SparkSession, mirror: str | None = None, local_only: bool = False, excludes: Excludes | None = None, delay: float = 0.3, limit: int = 0, api: str = MACHINES_API, get: Callable[[str], bytes] = files.fetch) -> DataFrame:
    """(file_name, content) of machine descriptions.

    With `local_only` from the mirror alone; else live, and where there is a mirror it stands in for a listing or a file that
    can't be had. Without a mirror a failed listing is an error. `limit`: so many first files of the listing.
    """
    if local_only and not mirror:
        raise ValueError("a mirror is needed to read nothing else")
    behind = files.mirror(spark, mirror, "*.xml", excludes, files.SKIP_PREFIXES) if mirror else None
    urls: dict[str, str] = {}
    if not local_only:
        try:
            urls = contents_listing(get(api), excludes)
        except (OSError, ValueError, KeyError, TypeError):
            if behind is None:
                raise
            log.exception("no listing; the mirror stands in")
            local_only = True
    if local_only:
        return behind.orderBy("file_name").limit(limit) if limit else behind
    urls = dict(list(urls.items())[:limit]) if limit else urls
    first = web_files(spark, urls, delay)
    if behind is None:
        return first
    first = first.persist()  # fetched once, though the join below reads it for names and contents
    return files.with_fallback(first.select("file_name"), first, behind)


def crawl(get: Callable[[str, str], bytes | None], base: str = pages.BASE) -> tuple[dict[str, bytes], dict[str, str]]:
    """(category pages by file name, {file name: address} of the model pages they list), in order of first sight.

    `get` takes an address and the file name of a mirrored copy. Each category is followed through its 'next' links; one that
    can't be had ends its category.
    """
    found: dict[str, bytes] = {}
    models: dict[str, str] = {}
    for slug in pages.CATEGORIES.values():
        first = url = f"{base}/wiki/{slug}"
        page = 1
        while url:
            name = files.mirrored_page(first, page)
            body = get(url, name)
            if body is None:
                break
            found[name] = body
            root = pages.tree(body)
            for n in pages.category_lists(root):
                for a in n.iter("a"):
                    href, title = a.attrs.get("href", ""), a.attrs.get("title", "") or a.text()
                    path = href.split("//", 1)[-1].partition("/")[2] if "//" in href else href.lstrip("/")
                    if path.startswith("wiki/") and not path.startswith(("wiki/Category:", "wiki/Special:")) and title and title not in pages.SKIP_TITLES:
                        models.setdefault(files.mirrored_page("/" + path), f"{base}/{path}")
            url = files.next_page([(a.attrs.get("href", ""), a.text()) for a in root.iter("a")], base)
            page += 1
    return found, models


def wiki_pages(spark: SparkSession, mirror: str | None = None, local_only: bool = False, delay: float = 0.5, limit: int = 0, base: str = pages.BASE, get: Callable[[str], bytes] | None = None) -> DataFrame:
    """(file_name, content) of category and model pages, from the sources as in `descriptions`; pages are asked for once each.

    `limit`: so many first model pages.
    """
    if local_only and not mirror:
        raise ValueError("a mirror is needed to read nothing else")
    behind = files.mirror(spark, mirror, "*.html") if mirror else None
    if local_only:
        if not limit:
            return behind
        listing = behind["file_name"].startswith("Category_")
        return behind.where(~listing).orderBy("file_name").limit(limit).unionByName(behind.where(listing))
    ask = get or (lambda url: files.fetch(url, retries=0))

    def page(url: str, name: str) -> bytes | None:
        try:
            return ask(url)
        except OSError as e:
            log.warning("%s: %s", url, e)
        for saved in (name, name.removesuffix(".html") + " - MSX Wiki.html") if mirror else ():
            if (at := Path(mirror) / saved).exists():
                return at.read_bytes()
        return None

    found, models = crawl(page, base)
    models = dict(list(models.items())[:limit]) if limit else models
    categories = spark.createDataFrame([(n, bytearray(b)) for n, b in found.items()], files.BLOBS)
    got = web_files(spark, models, delay, retries=0)
    if behind is not None:
        got = got.persist()
        named = behind.withColumn("file_name", pages.page_file("file_name"))
        got = files.with_fallback(got.select("file_name"), got, named)
    return categories.unionByName(got)
