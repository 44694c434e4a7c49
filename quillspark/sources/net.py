"""Network access with the standard library: fetchers for ``fetch_all`` and a prober of sites. Each call answers; failures are values."""

from __future__ import annotations

import socket
import time
import urllib.error
import urllib.request
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

#: Answers to a HEAD request after which GET is tried (fixed values).
TRY_GET = (400, 401, 403, 405)


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


@dataclass
class Fetcher:
    """``Fetcher()(url)`` gives the fields of ``links.ANSWER`` but for the url. HEAD comes first unless the body is wanted."""

    body: bool = True
    head_first: bool = True
    timeout: float = 10.0
    max_redirects: int = 10
    most_bytes: int = 5 << 20
    agent: str = "Mozilla/5.0"

    def _once(self, method: str, url: str) -> tuple[int, dict, bytes]:
        ask = urllib.request.Request(url, method=method, headers={"User-Agent": self.agent, "Accept": "text/html,*/*;q=0.8"})
        try:
            answer = urllib.request.build_opener(_Stay).open(ask, timeout=self.timeout)
        except urllib.error.HTTPError as e:
            answer = e
        with answer:
            return answer.status, dict(answer.headers.items()), answer.read(self.most_bytes) if method == "GET" and self.body else b""

    def _follow(self, method: str, url: str) -> dict:
        began, chain = time.perf_counter(), [url]
        while True:
            status, headers, body = self._once(method, chain[-1])
            to = headers.get("Location") if status in (301, 302, 303, 307, 308) else None
            if not to:
                break
            if len(chain) > self.max_redirects:
                return {"final_url": chain[-1], "http_status": status, "chain": chain, "content_type": None, "html": None, "ms": None, "error": f"Exceeded max_redirects={self.max_redirects}"}
            chain.append(urljoin(chain[-1], to))
        kind = headers.get("Content-Type", "")
        coding = next((p.partition("=")[2].strip() for p in kind.split(";") if p.strip().lower().startswith("charset=")), "utf-8")
        try:
            text = body.decode(coding, "replace")
        except LookupError:
            text = body.decode("utf-8", "replace")
        return {"final_url": chain[-1], "http_status": status, "chain": chain, "content_type": kind, "html": text if method == "GET" and self.body else None, "ms": (time.perf_counter() - began) * 1000, "error": None}

    def __call__(self, url: str) -> dict:
        if self.head_first:
            try:
                got = self._follow("HEAD", url)
            except (OSError, ValueError):
                got = None
            if got and got["http_status"] not in TRY_GET and not (self.body and got["error"] is None and got["http_status"] == 200):
                return got
        try:
            return self._follow("GET", url)
        except (OSError, ValueError) as e:
            return {"final_url": None, "http_status": None, "chain": [], "content_type": None, "html": None, "ms": None, "error": str(getattr(e, "reason", e))}


@dataclass
class Prober:
    """``Prober()(candidates)`` gives the fields of ``links.PROBE`` but for the site: names, ports 443 and 80, and an attempt for each address until one answers."""

    fetch: object = None
    timeout: float = 5.0
    ports: tuple[int, int] = (443, 80)

    def _port(self, host: str, port: int) -> tuple[bool, str | None]:
        try:
            socket.create_connection((host, port), timeout=self.timeout).close()
            return True, None
        except OSError as e:
            return False, f"TCP {port} error: {e}"

    def __call__(self, candidates: list[str]) -> dict:
        host = next((h for u in candidates if (h := urlsplit(u).hostname)), "")
        ips, dns_error = [], None if host else "Missing hostname"
        if host:
            try:
                ips = list(dict.fromkeys(x[4][0] for x in socket.getaddrinfo(host, None)))
            except OSError as e:
                dns_error = f"DNS error: {e}"
        tls, tls_error = self._port(host, self.ports[0]) if ips else (False, dns_error)
        plain, plain_error = self._port(host, self.ports[1]) if ips else (False, dns_error)
        attempts, fetch = [], self.fetch or Fetcher(body=False, timeout=self.timeout)
        for u in candidates if ips else []:
            got = fetch(u)
            attempts.append({"url": u, **{k: got[k] for k in ("final_url", "http_status", "chain", "ms", "error")}})
            if got["error"] is None:
                break
        return {"dns_ok": bool(ips), "resolved_ips": ips, "dns_error": dns_error, "tcp_443_ok": tls, "tcp_443_error": tls_error, "tcp_80_ok": plain, "tcp_80_error": plain_error, "attempts": attempts}
