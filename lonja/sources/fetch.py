"""Image fetch stage: bounded HTTP reads with retries, behind a guard against private addresses.

A partition fetches with a pool of threads and yields rows as they come, so downloads overlap and memory holds one small
group of images at a time.
"""

from __future__ import annotations

import http.client
import ipaddress
import socket
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

#: Statuses worth another try (fixed values).
RETRY_STATUS = frozenset({500, 502, 503, 504})
_SHARED = ipaddress.ip_network("100.64.0.0/10")


@dataclass(frozen=True)
class FetchOptions:
    timeout: float = 15.0
    attempts: int = 3
    pause: float = 0.5
    redirects: int = 5
    max_bytes: int = 25 * 1024 * 1024
    threads: int = 32
    allow_private: bool = False


def is_private(address: str) -> bool:
    """Loopback, private, link-local, multicast, broadcast, unspecified, documentation, shared or mapped such."""
    ip = ipaddress.ip_address(address)
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    return not ip.is_global or ip.is_multicast or ip.is_reserved or ip.version == 4 and ip in _SHARED


def host_is_public(host: str, resolve: Callable = socket.getaddrinfo) -> bool:
    try:
        found = {entry[4][0] for entry in resolve(host, None)}
    except OSError:
        return False
    return bool(found) and not any(is_private(a.split("%")[0]) for a in found)


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args: object) -> None:
        return None


_opener = urllib.request.build_opener(_NoRedirect)


def fetch(url: str, options: FetchOptions = FetchOptions()) -> tuple[bytes | None, str | None]:
    """The bytes, or the reason why there are none."""
    failure = "sin intentos"
    for attempt in range(options.attempts):
        if attempt:
            time.sleep(options.pause * attempt)
        content, failure, again = _once(url, options)
        if content is not None or not again:
            return content, failure
    return None, failure


def _once(url: str, options: FetchOptions) -> tuple[bytes | None, str | None, bool]:
    for _ in range(options.redirects + 1):
        parts = urllib.parse.urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            return None, "URL no válida", False
        if not options.allow_private and not host_is_public(parts.hostname):
            return None, "destino no permitido", False
        try:
            with _opener.open(urllib.request.Request(url, headers={"User-Agent": "lonja"}), timeout=options.timeout) as reply:
                kind = reply.headers.get_content_type() if reply.headers.get("Content-Type") else ""
                if kind and not kind.startswith("image/") and kind != "application/octet-stream":
                    return None, f"tipo de contenido {kind}", False
                content = reply.read(options.max_bytes + 1)
                return (None, "demasiado grande", False) if len(content) > options.max_bytes else (content, None, False)
        except urllib.error.HTTPError as error:
            if error.code in (301, 302, 303, 307, 308) and error.headers.get("Location"):
                url = urllib.parse.urljoin(url, error.headers["Location"])
                continue
            return None, f"estado HTTP {error.code}", error.code in RETRY_STATUS
        except (OSError, http.client.HTTPException) as error:
            return None, f"error de red: {error}", True
    return None, "demasiadas redirecciones", False


def fetched(batches: Iterator[pd.DataFrame], options: FetchOptions = FetchOptions()) -> Iterator[pd.DataFrame]:
    """Small groups of the rows, ``url`` fetched into ``content`` or ``failure``; downloads of a group overlap."""
    step = options.threads * 2
    with ThreadPoolExecutor(options.threads) as pool:
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                found = list(pool.map(lambda u: fetch(u, options), part["url"]))
                yield part.assign(content=[c for c, _ in found], failure=[f for _, f in found])


def fetch_images(tasks: DataFrame, options: FetchOptions = FetchOptions()) -> DataFrame:
    """``tasks(idx, col, url)`` with ``content`` and ``failure``."""
    return tasks.select("idx", "col", "url").mapInPandas(lambda batches: fetched(batches, options), "idx long, col string, url string, content binary, failure string")
