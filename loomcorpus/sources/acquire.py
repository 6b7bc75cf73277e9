"""Acquisition of source files through a fetch function, by default HTTP; run by the driver for a short list."""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable, Iterable
from pathlib import Path
from urllib.request import Request, urlopen

from pyspark.sql import Column
from pyspark.sql import functions as F

PDF_BYTES = 100_000  # less is an error page


def http_get(url: str, timeout: float = 60.0) -> bytes:
    with urlopen(Request(url, headers={"User-Agent": "loomcorpus"}), timeout=timeout) as r:
        return r.read()


def ordinal_name(place: int, url: str) -> str:
    """The file name of the page at a place, from 1: two digits, a dash, the last part of its address."""
    return f"{place:02d}-{url.rstrip('/').rsplit('/', 1)[-1].removesuffix('.html')}.html"


def ordinal_names(place: Column, url: Column) -> Column:
    """The same for columns; place as a string."""
    slug = F.regexp_replace(F.regexp_extract(F.rtrim(url, F.lit("/")), "[^/]*$", 0), r"\.html$", "")
    return F.concat(F.when(F.length(place) < 2, F.lpad(place, 2, "0")).otherwise(place), F.lit("-"), slug, F.lit(".html"))


def acquire(files: Iterable[tuple[str, str]], folder: str, fetch: Callable[[str], bytes] = http_get, least_bytes: int = 0, pause: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """Fetch (name, url) into a folder; one dict for each: name, bytes, state (kept, saved or failed), error.

    A file that is there is kept, so a second run fetches what is missing; one under `least_bytes` isn't stored.
    """
    top, out = Path(folder), []
    top.mkdir(parents=True, exist_ok=True)
    for name, url in files:
        path = top / name
        if path.exists():
            out.append({"name": name, "bytes": path.stat().st_size, "state": "kept", "error": None})
            continue
        try:
            data = fetch(url)
            if len(data) < least_bytes:
                raise ValueError(f"{len(data)} bytes are fewer than {least_bytes}")
            part = path.with_name(path.name + ".part")
            part.write_bytes(data)
            part.rename(path)
            out.append({"name": name, "bytes": len(data), "state": "saved", "error": None})
        except Exception as e:
            out.append({"name": name, "bytes": 0, "state": "failed", "error": f"{type(e).__name__}: {e}"})
        if pause:
            sleep(pause)
    return out


def acquire_repository(url: str, folder: str, run: Callable[..., object] = subprocess.run) -> dict:
    """A shallow clone of a repository into a folder; one that is there is kept.  The dict is as those of acquire."""
    top = Path(folder)
    if (top / ".git").exists():
        return {"name": top.name, "bytes": _size(top), "state": "kept", "error": None}
    try:
        top.parent.mkdir(parents=True, exist_ok=True)
        run(["git", "clone", "--depth", "1", url, str(top)], check=True, capture_output=True)
        return {"name": top.name, "bytes": _size(top), "state": "saved", "error": None}
    except Exception as e:
        return {"name": top.name, "bytes": 0, "state": "failed", "error": f"{type(e).__name__}: {e}"}


def _size(top: Path) -> int:
    return sum(p.stat().st_size for p in top.rglob("*") if p.is_file() and ".git" not in p.relative_to(top).parts)


def acquire_pages(urls: list[str], folder: str, **options) -> list[dict]:
    """The pages of a table of contents, in order, under ordinal names."""
    return acquire(((ordinal_name(i, u), u) for i, u in enumerate(urls, 1)), folder, **options)
