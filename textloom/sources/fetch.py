"""Remote resources as corpora: credentials, downloads with retries and checks, archives unpacked, git repositories checked out.

`resolved` fetches all resources of a configuration in tasks, one each: archives are written to a cache folder that all
executors share and read from there as a data source; a repository is checked out in its task's own folder, whose files
become rows of a table in the cache. Downloads are kept by the hash of their URL and pinned in a lock file. `fetch` takes one
resource through a local cache, for use without a cluster.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import shutil
import subprocess
import tempfile
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from textloom.sources.archives import MOST, contents, members, read_archives
from textloom.sources.remote import ArchiveUrl, GitUrl, allowed, archive_url, git_url, integrity, with_retries

Opener = Callable[[str, Mapping[str, str]], bytes]


def credentials(auth: Mapping[str, str] | None, env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """The headers of a resource's `auth`: a bearer token, or a user's name and password, each named by a variable."""
    if not auth:
        return {}
    need = {"bearer": ["tokenEnv"], "basic": ["username", "passwordEnv"]}.get(auth.get("type", ""))
    if need is None:
        raise ValueError(f"auth type {auth.get('type')!r}")
    missing = [k for k in need if not auth.get(k)] + [auth[k] for k in need if k.endswith("Env") and auth.get(k) and not env.get(auth[k])]
    if missing:
        raise ValueError(f"auth needs {', '.join(missing)}")
    if auth["type"] == "bearer":
        return {"Authorization": f"Bearer {env[auth['tokenEnv']]}"}
    pair = f"{auth['username']}:{env[auth['passwordEnv']]}"
    return {"Authorization": "Basic " + base64.b64encode(pair.encode()).decode()}


def download(url: str, headers: Mapping[str, str]) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers=dict(headers)), timeout=60) as answer:  # noqa: S310  the caller checked the URL
        return answer.read()


def unpacked(name: str, data: bytes, folder: str = "", most: int = MOST) -> list[tuple[str, str]]:
    """path, content of an archive's files below a folder, as UTF-8."""
    found = members(name, io.BytesIO(data), folder, most)
    return sorted((m.path, x.decode("utf-8", "replace")) for m, x in contents(name, io.BytesIO(data), found))


def key_of(url: str) -> str:
    return hashlib.sha256(url.encode()).hexdigest()[:32]


def fetch_archive(found: ArchiveUrl, cache: str, *, auth: Mapping[str, str] | None = None, sha256: str | None = None, opener: Opener = download, tries: int = 3, offline: bool = False, env: Mapping[str, str] = os.environ) -> tuple[Path, dict]:
    """The archive's file in the cache and its lock entry; ValueError if its bytes are not those that were asked for."""
    kept = Path(cache, key_of(found.url) + "-" + found.url.rsplit("/", 1)[-1])
    want = sha256 or found.sha256
    if kept.exists():
        data = kept.read_bytes()
    elif offline:
        raise FileNotFoundError(f"{found.url} is not in the cache")
    else:
        data = with_retries(lambda: opener(found.url, credentials(auth, env)), tries)
    have = integrity(data)
    if want and have.removeprefix("sha256-") != want.removeprefix("sha256-").lower():
        raise ValueError(f"{found.url}: has {have}, not sha256-{want.removeprefix('sha256-')}")
    if not kept.exists():
        kept.parent.mkdir(parents=True, exist_ok=True)
        part = kept.with_suffix(".part")
        part.write_bytes(data)
        part.replace(kept)
    return kept, {"url": found.url, "resolved": found.url, "integrity": have}


def git(*arguments: str, where: str | None = None) -> str:
    return subprocess.run(["git", *arguments], cwd=where, check=True, capture_output=True, text=True, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"}).stdout.strip()


def fetch_git(found: GitUrl, cache: str, *, update: bool = False, offline: bool = False, headers: Mapping[str, str] | None = None) -> tuple[Path, dict]:
    """The checked out folder in the cache and its lock entry, which names the commit. A commit, a tag or a branch will do."""
    home = Path(cache, key_of(f"{found.repository}@{found.ref}"))
    if not home.exists() or update:
        if offline:
            raise FileNotFoundError(f"{found.repository} is not in the cache")
        extra = [x for k, v in (headers or {}).items() for x in ("-c", f"http.extraHeader={k}: {v}")]
        if not home.exists():
            git(*extra, "clone", "--quiet", "--no-checkout", "--filter=blob:none", found.repository, str(home))
        else:
            git(*extra, "fetch", "--quiet", "--tags", "origin", where=str(home))
        names = git("for-each-ref", "--format=%(refname)", f"refs/remotes/origin/{found.ref}", where=str(home))
        git(*extra, "checkout", "--quiet", "--detach", f"origin/{found.ref}" if names else found.ref, where=str(home))
    commit = git("rev-parse", "HEAD", where=str(home))
    folder = Path(home, found.folder).resolve()
    if not folder.is_relative_to(home.resolve()):
        raise ValueError(f"{found.folder!r} leads out of the repository")
    return folder, {"url": found.repository, "resolved": commit, "integrity": f"git-{commit}"}


def fetch(spark: SparkSession, resource: str | Mapping, cache: str, *, security: Mapping | None = None, lock: dict[str, dict] | None = None, offline: bool = False, opener: Opener = download, env: Mapping[str, str] = os.environ) -> tuple[DataFrame, dict]:
    """path, content of a remote resource (a URL, or url, sha256 and auth) and its lock entry.

    A lock entry of the URL pins an archive's bytes, or a repository's commit.
    """
    from textloom.sources.files import read_corpus

    entry = {"url": resource} if isinstance(resource, str) else dict(resource)
    rules = security or {}
    if why := allowed(entry["url"], rules.get("allowedHosts"), rules.get("allowedProtocols")):
        raise PermissionError(why)
    if found := archive_url(entry["url"]):
        pin = (lock or {}).get(found.url, {}).get("integrity")
        kept, now = fetch_archive(found, cache, auth=entry.get("auth"), sha256=entry.get("sha256") or pin, opener=opener, offline=offline, env=env)
        return read_archives(spark, str(kept), found.folder).select("path", "content"), now
    if repo := git_url(entry["url"]):
        pin = (lock or {}).get(repo.repository, {}).get("resolved")
        folder, now = fetch_git(repo._replace(ref=pin) if pin else repo, cache, offline=offline, headers=credentials(entry.get("auth"), env))
        return read_corpus(spark, str(folder)), now
    raise ValueError(f"{entry['url']!r} is neither a repository nor an archive")


# All resources of a configuration, fetched by tasks.


def kept_archive(found: ArchiveUrl, cache: str, want: str | None, offline: bool, headers: Mapping[str, str], opener: Opener, tries: int) -> tuple[str, str]:
    """URI of an archive in a shared cache, and its integrity."""
    system, root = fs.FileSystem.from_uri(cache) if "://" in cache else (fs.LocalFileSystem(), cache)
    path = f"{root.rstrip('/')}/{key_of(found.url)}/{found.url.rsplit('/', 1)[-1]}"
    there = system.get_file_info(path).type == fs.FileType.File
    if there:
        with system.open_input_stream(path, compression=None) as source:
            data = source.read()
    elif offline:
        raise FileNotFoundError(f"{found.url} is not in the cache")
    else:
        data = with_retries(lambda: opener(found.url, headers), tries)
    have = integrity(data)
    if want and have.removeprefix("sha256-") != want.removeprefix("sha256-").lower():
        raise ValueError(f"{found.url}: has {have}, not sha256-{want.removeprefix('sha256-')}")
    if not there:
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{os.getpid()}.part"  # another try of the task writes another
        with system.open_output_stream(part, compression=None) as out:
            out.write(data)
        system.move(part, path)
    return path if "://" not in cache else cache.split("://", 1)[0] + "://" + path, have


def checked_out(found: GitUrl, ref: str, headers: Mapping[str, str]) -> tuple[str, list[tuple[str, str]]]:
    """The commit and the markdown files of a repository's folder, by a checkout that is deleted again."""
    from textloom.sources.files import EXTENSIONS, SKIPPED

    with tempfile.TemporaryDirectory() as where:  # of this task alone: its files leave as rows
        folder, entry = fetch_git(found._replace(ref=ref), where, headers=headers)
        files = []
        for path in sorted(folder.rglob("*")):
            name = path.relative_to(folder).as_posix()
            if path.is_file() and not path.is_symlink() and name.endswith(tuple(f".{e}" for e in EXTENSIONS)) and not set(name.split("/")[:-1]) & set(SKIPPED):
                files.append((name, path.read_text(encoding="utf-8", errors="replace")))
        shutil.rmtree(folder, ignore_errors=True)
    return entry["resolved"], files


def resolved(spark: SparkSession, resources: list[str | Mapping], cache: str, *, security: Mapping | None = None, lock: Mapping[str, dict] | None = None, offline: bool = False, opener: Opener = download, tries: int = 3, env: Mapping[str, str] = os.environ) -> tuple[DataFrame, dict[str, dict]]:
    """place (in the list), path, content of all remote resources, and their lock entries.

    cache: a folder that all executors share. Each resource is one task's download; archives are then read by as many tasks
    as their size asks for.
    """
    rows = []
    for k, r in enumerate(resources):
        entry = {"url": r} if isinstance(r, str) else dict(r)
        if why := allowed(entry["url"], (security or {}).get("allowedHosts"), (security or {}).get("allowedProtocols")):
            raise PermissionError(why)
        archive, repo = archive_url(entry["url"]), git_url(entry["url"])
        if not archive and not repo:
            raise ValueError(f"{entry['url']!r} is neither a repository nor an archive")
        key = archive.url if archive else repo.repository
        pin = (lock or {}).get(key, {})
        rows.append((k, entry["url"], entry.get("sha256") or pin.get("integrity") if archive else pin.get("resolved"), list(credentials(entry.get("auth"), env).items())))
    schema = "place int, url string, pin string, headers array<struct<k:string,v:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                headers = {h["k"]: h["v"] for h in r["headers"]}
                if found := archive_url(r["url"]):
                    where, have = kept_archive(found, cache, r["pin"] or found.sha256, offline, headers, opener, tries)
                    out = [(r["place"], found.url, found.url, have, where, found.folder, None, None)]
                else:
                    repo = git_url(r["url"])
                    if offline:
                        raise FileNotFoundError(f"{repo.repository} is not in the cache")
                    commit, files = checked_out(repo, r["pin"] or repo.ref, headers)
                    out = [(r["place"], repo.repository, commit, f"git-{commit}", None, None, p, c) for p, c in files or [(None, None)]]
                names = ["place", "url", "resolved", "integrity", "archive", "folder", "path", "content"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.string()) for k, c in enumerate(zip(*out, strict=True))], names)

    asked = spark.createDataFrame(rows, schema).repartition(max(len(rows), 1), "place")
    table = f"{cache.rstrip('/')}/fetched-{hashlib.sha256(repr([r[:3] for r in rows]).encode()).hexdigest()[:16]}"
    asked.mapInArrow(run, "place int, url string, resolved string, integrity string, archive string, folder string, path string, content string").write.mode("overwrite").parquet(table)
    got = spark.read.parquet(table)
    told = got.select("place", "url", "resolved", "integrity", "archive", "folder").distinct().collect()  # a row a resource
    out = got.filter("path IS NOT NULL").select("place", "path", "content")
    for r in told:
        if r["archive"]:
            part = read_archives(spark, r["archive"], r["folder"])
            out = out.unionByName(part.selectExpr(f"{r['place']} AS place", "path", "content"))
    return out, {r["url"]: {"url": r["url"], "resolved": r["resolved"], "integrity": r["integrity"]} for r in told}
