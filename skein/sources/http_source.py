"""Positional reads over HTTP ranges."""

from __future__ import annotations

import urllib.error
import urllib.parse
import urllib.request

MAX_REDIRECTS = 10


class RangeError(OSError):
    """A server that doesn't answer a range request with that range."""


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


class RangeReader:
    """read_at(offset, length) by one GET each. A redirect is resolved against the URL, followed and remembered; any
    answer but 206 is an error, a short one too. opener: anything with urllib's open(request), for login or TLS."""

    def __init__(self, url: str, opener=None):
        self.url, self.opener = url, opener or urllib.request.build_opener(_NoRedirect)

    def _ask(self, method: str, headers: dict):
        for _ in range(MAX_REDIRECTS + 1):
            try:
                answer = self.opener.open(urllib.request.Request(self.url, headers=headers, method=method), timeout=60)
            except urllib.error.HTTPError as e:
                answer = e
            if 300 <= answer.status < 400 and (to := answer.headers.get("Location")):
                self.url = urllib.parse.urljoin(self.url, to)
                answer.close()
                continue
            return answer
        raise RangeError(f"more than {MAX_REDIRECTS} redirects")

    def size(self) -> int:
        with self._ask("HEAD", {}) as answer:
            if answer.status != 200 or answer.headers.get("Content-Length") is None:
                raise RangeError(f"HEAD gave {answer.status}")
            return int(answer.headers["Content-Length"])

    def read_at(self, offset: int, length: int) -> bytes:
        if length <= 0:
            return b""
        with self._ask("GET", {"Range": f"bytes={offset}-{offset + length - 1}"}) as answer:
            if answer.status != 206:
                raise RangeError(f"a range request gave {answer.status}")
            got = answer.read(length)
        if len(got) < length:
            raise RangeError("the answer is cut short")
        return got

    def read_all(self, step: int = 1 << 20) -> bytes:
        n = self.size()
        return b"".join(self.read_at(a, min(step, n - a)) for a in range(0, n, step))
