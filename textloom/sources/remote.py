"""Remote resources: their URLs, security rules, lock files and retry waits. Fetching itself is a callable that callers give."""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame

ARCHIVES = (".tar.gz", ".tgz", ".tar", ".zip")


class GitUrl(NamedTuple):
    repository: str
    folder: str
    ref: str


class ArchiveUrl(NamedTuple):
    url: str
    folder: str
    sha256: str | None


def git_url(text: str) -> GitUrl | None:
    """git::URL//folder?ref=name, host/org/repo//folder?ref=name, or git@host:org/repo.git//folder."""
    forced = text.startswith("git::")
    body, _, query = text.removeprefix("git::").partition("?")
    ref = parse_qs(query).get("ref", ["main"])[0]
    scheme = re.match(r"[a-z+]+://", body)
    head = scheme[0] if scheme else ""
    repository, _, folder = body[len(head) :].partition("//")
    known = re.match(r"(github\.com|gitlab\.com|bitbucket\.org)/[^/]+/[^/]+", repository) or re.match(r"git@[^:]+:.+", repository)
    if not forced and not known and not repository.endswith(".git"):
        return None
    if not head and not repository.startswith("git@"):
        head = "https://"
    url = head + repository
    return GitUrl(url if url.endswith(".git") else url + ".git", folder.strip("/"), ref)


def archive_url(text: str) -> ArchiveUrl | None:
    parts = urlsplit(text)
    if parts.scheme not in ("http", "https"):
        return None
    path, _, folder = parts.path.partition("//")
    if not path.lower().endswith(ARCHIVES):
        return None
    return ArchiveUrl(f"{parts.scheme}://{parts.netloc}{path}", folder.strip("/"), parse_qs(parts.query).get("sha256", [None])[0])


def allowed(url: str, hosts: list[str] | None = None, protocols: list[str] | None = None) -> str | None:
    """Why a URL may not be fetched, if so. A host rule covers its subdomains when it begins with *."""
    m = re.match(r"(?:git::)?(?:([a-z+]+)://)?(?:[^@/]+@)?([^/:?]+)", url)
    protocol, host = (m[1] or "https", m[2].lower()) if m else ("", "")
    if protocols and protocol not in protocols:
        return f"protocol {protocol!r} is not allowed"
    if hosts and not any(host == h.lower() or h.startswith("*.") and host.endswith(h[1:].lower()) for h in hosts):
        return f"host {host!r} is not allowed"
    return None


def integrity(data: bytes) -> str:
    return "sha256-" + hashlib.sha256(data).hexdigest()


def waits(tries: int, first: float = 1.0, most: float = 30.0, seed: int | None = None) -> list[float]:
    """Seconds between tries: doubling, with up to a quarter of jitter."""
    rng = random.Random(seed)
    return [min(most, first * 2**k) * (1 + 0.25 * rng.random()) for k in range(tries - 1)]


def with_retries(call: Callable[[], bytes], tries: int = 3, first: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> bytes:
    pauses = [*waits(tries, first), None]
    for pause in pauses:
        try:
            return call()
        except OSError:
            if pause is None:
                raise
            sleep(pause)
    raise AssertionError


def read_lock(text: str) -> dict[str, dict]:
    """Lock entries by URL."""
    data = json.loads(text)
    if data.get("version") != 1 or not isinstance(data.get("resources"), list):
        raise ValueError("not a lock file")
    return {e["url"]: e for e in data["resources"]}


def write_lock(entries: dict[str, dict]) -> str:
    return json.dumps({"version": 1, "resources": [entries[k] for k in sorted(entries)]}, indent=2)


def pinned(resources: DataFrame, lock: DataFrame) -> DataFrame:
    """Resources with what their lock entry resolved to, null where they have none."""
    return resources.join(lock.select("url", "resolved", "integrity"), "url", "left")
