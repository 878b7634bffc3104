"""A Spark data source that fetches pages over HTTP: format "webpages".

    spark.dataSource.register(WebPages)
    spark.read.format("webpages").option("urls", "https://a.example/1\nhttps://a.example/2").load()

A host's URLs are in one partition, so one task keeps to its pace, and there are as many partitions as requests may run at
once. `intervals` ("host seconds" a line) sets longer pauses for hosts, `last` ("host time" a line) tells when a host was
asked before, so that a crawl keeps the pace from one read to the next. Addresses are vetted before a connection is made,
each redirect again.
"""

from __future__ import annotations

import http.client
import os
import socket
import ssl
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.policy import is_public_ip

SCHEMA = "input_idx bigint, url string, html string, status_code int, error string"
REDIRECTS = (301, 302, 303, 307, 308)


class Rejected(Exception):
    """A URL or response that no retry makes acceptable."""


@dataclass
class Settings:
    timeout: float = 10.0
    max_response_size: int = 2 << 20
    max_retries: int = 2
    rate_limit: float = 2.0
    min_interval: float = 0.0
    max_concurrent: int = 4
    max_redirects: int = 3
    allow_private: bool = False
    require_html: bool = True
    follow_redirects: bool = True
    user_agent: str = "pagesim/0.1"

    def __post_init__(self):
        for name in ("timeout", "max_response_size", "rate_limit", "max_concurrent"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.max_retries < 0:
            raise ValueError("max_retries must not be negative")

    @property
    def interval(self) -> float:
        return max(1 / self.rate_limit, self.min_interval)


def url_problem(url: str) -> str | None:
    """As functions.urls.problem, for one URL."""
    if not url:
        return "URL must be a non-empty string"
    parts = urlsplit(url)
    if parts.scheme.lower() not in ("http", "https"):
        return "only http:// and https:// URLs are supported"
    if not parts.hostname:
        return "URL must include a hostname"
    if parts.username is not None or parts.password is not None:
        return "credentials in URLs are not allowed"
    try:
        parts.port
    except ValueError as e:
        return f"invalid URL port: {e}"
    return None


def vetted_address(host: str, port: int, allow_private: bool) -> str:
    """The first of a host's addresses in order, if all are public."""
    addresses = sorted({a[4][0] for a in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)})
    if not addresses:
        raise OSError(f"no address for {host}")
    if not allow_private and (bad := [a for a in addresses if not is_public_ip(a)]):
        raise Rejected(f"Blocked non-public address for {host}: {bad[0]}")
    return addresses[0]


def tls_context() -> ssl.SSLContext:
    """Certificates of SSL_CERT_FILE, else of SSL_CERT_DIR, else the system's."""
    if path := os.environ.get("SSL_CERT_FILE"):
        return ssl.create_default_context(cafile=path)
    if path := os.environ.get("SSL_CERT_DIR"):
        return ssl.create_default_context(capath=path)
    return ssl.create_default_context()


class _Pinned(http.client.HTTPConnection):
    """A connection to a vetted address that still names the host."""

    def __init__(self, host: str, port: int, address: str, timeout: float, tls: ssl.SSLContext | None):
        super().__init__(host, port, timeout=timeout)
        self.address, self.tls = address, tls

    def connect(self):
        self.sock = socket.create_connection((self.address, self.port), self.timeout)
        if self.tls:
            self.sock = self.tls.wrap_socket(self.sock, server_hostname=self.host)


def decoded(chunks: Iterator[bytes], encoding: str, limit: int) -> bytes:
    """The body, unpacked a piece at a time so that no more than the limit is ever held."""
    unpack = {"gzip": lambda: zlib.decompressobj(31), "deflate": lambda: zlib.decompressobj()}.get(encoding, lambda: None)()
    out, total, first = [], 0, True
    for chunk in chunks:
        while chunk:
            if unpack is None:
                piece, chunk = chunk, b""
            else:
                try:
                    piece = unpack.decompress(chunk, limit + 1 - total)
                except zlib.error:
                    if encoding != "deflate" or not first:
                        raise
                    unpack = zlib.decompressobj(-15)  # some servers leave the wrapper out
                    piece = unpack.decompress(chunk, limit + 1 - total)
                chunk = unpack.unconsumed_tail
            first = False
            total += len(piece)
            if total > limit:
                raise Rejected(f"Response exceeded {limit} bytes")
            out.append(piece)
    return b"".join(out)


def _once(url: str, s: Settings) -> tuple[str | None, int, str | None, str | None]:
    """(text, status, error, redirect) of one request."""
    if why := url_problem(url):
        raise Rejected(why)
    parts = urlsplit(url)
    secure = parts.scheme.lower() == "https"
    port = parts.port or (443 if secure else 80)
    address = vetted_address(parts.hostname, port, s.allow_private)
    link = _Pinned(parts.hostname, port, address, s.timeout, tls_context() if secure else None)
    try:
        target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        link.request("GET", target, headers={"Host": parts.netloc, "User-Agent": s.user_agent, "Accept-Encoding": "gzip, deflate"})
        answer = link.getresponse()
        if answer.status in REDIRECTS and answer.getheader("Location") and s.follow_redirects:
            return None, answer.status, None, urljoin(url, answer.getheader("Location"))
        encoding = (answer.getheader("Content-Encoding") or "").strip().lower()
        if encoding not in ("", "identity", "gzip", "deflate"):
            return None, answer.status, f"Unsupported content encoding: {encoding}", None
        kind = (answer.getheader("Content-Type") or "").split(";")[0].strip().lower()
        if s.require_html and kind not in ("text/html", "application/xhtml+xml"):
            return None, answer.status, f"Unsupported content type: {kind or 'missing'}", None
        announced = answer.getheader("Content-Length") or ""
        if encoding in ("", "identity") and announced.isdigit() and int(announced) > s.max_response_size:
            return None, answer.status, f"Response too large: {announced} bytes", None
        body = decoded(iter(lambda: answer.read(65536), b""), encoding, s.max_response_size)
        charset = answer.headers.get_content_charset() or "utf-8"
        try:
            text = body.decode(charset)
        except (LookupError, UnicodeDecodeError):
            text = body.decode("utf-8", "replace")
        return text, answer.status, None, None
    finally:
        link.close()


def fetch(url: str, s: Settings) -> tuple[str | None, int | None, str | None]:
    """(text, status, error); transport errors are tried again after 1, 2, 4 ... seconds, answers and refusals are not."""
    error = None
    for attempt in range(s.max_retries + 1):
        try:
            at = url
            for _ in range(s.max_redirects + 1):
                text, status, error, to = _once(at, s)
                if to is None:
                    return text, status, error
                at = to
            return None, status, f"Too many redirects (more than {s.max_redirects})"
        except Rejected as e:
            return None, None, str(e)
        except (OSError, http.client.HTTPException, zlib.error) as e:
            error = f"{type(e).__name__}: {e}"
            if attempt < s.max_retries:
                time.sleep(2**attempt)
    return None, None, error


@dataclass
class HostUrls(InputPartition):
    hosts: list[list[tuple[int, str]]]


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], settings: Settings, intervals: dict[str, float], last: dict[str, float]):
        self.urls, self.settings, self.intervals, self.last = urls, settings, intervals, last

    def partitions(self):
        """Hosts dealt over max_concurrent partitions, the one with the most URLs first, each to the shortest."""
        hosts: dict[str, list[tuple[int, str]]] = {}
        for k, u in enumerate(self.urls):
            hosts.setdefault(urlsplit(u).netloc.lower(), []).append((k, u))
        parts: list[list[list[tuple[int, str]]]] = [[] for _ in range(min(self.settings.max_concurrent, len(hosts)))]
        for own in sorted(hosts.values(), key=len, reverse=True):
            min(parts, key=lambda p: sum(map(len, p))).append(own)
        return [HostUrls(p) for p in parts]

    def read(self, partition):
        """Hosts take turns, so that one's pause is another's time; rows come as pages do."""
        waiting = [(own, max(self.settings.interval, self.intervals.get(urlsplit(own[0][1]).netloc.lower(), 0.0))) for own in partition.hosts]
        due = [self.last.get(urlsplit(own[0][1]).netloc.lower(), 0.0) + pause for own, pause in waiting]
        places = [0] * len(waiting)
        while any(k < len(own) for k, (own, _) in zip(places, waiting)):
            i = min((i for i, (own, _) in enumerate(waiting) if places[i] < len(own)), key=due.__getitem__)
            time.sleep(max(0.0, due[i] - time.time()))
            due[i] = time.time() + waiting[i][1]
            k, u = waiting[i][0][places[i]]
            places[i] += 1
            yield (k, u, *fetch(u, self.settings))


def _numbers(lines: str) -> dict[str, float]:
    return {host.lower(): float(x) for host, x in (line.rsplit(" ", 1) for line in lines.split("\n") if line)}


class WebPages(DataSource):
    @classmethod
    def name(cls):
        return "webpages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        o = {k.lower(): v for k, v in self.options.items()}
        kinds = {"timeout": float, "max_response_size": int, "max_retries": int, "rate_limit": float, "min_interval": float, "max_concurrent": int, "user_agent": str}
        given = {k: kind(o[k]) for k, kind in kinds.items() if k in o}
        flags = {k: o[k].lower() == "true" for k in ("allow_private", "require_html", "follow_redirects") if k in o}
        return _Reader([u for u in o.get("urls", "").split("\n") if u], Settings(**given, **flags), _numbers(o.get("intervals", "")), _numbers(o.get("last", "")))
