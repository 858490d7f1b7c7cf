"""HTTP requests with retries, shared by the REST source and sink."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from dataclasses import dataclass
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

# Statuses worth another try.
RETRIED = frozenset({408, 429, 500, 502, 503, 504})


@dataclass(frozen=True)
class Retry:
    """Attempts, first wait in seconds, its growth and its bound; Retry-After is obeyed up to 300 seconds."""

    attempts: int = 3
    backoff: float = 0.5
    factor: float = 2.0
    longest: float = 30.0

    def wait(self, failed: int, retry_after: str | None) -> float:
        if retry_after and retry_after.strip().isdigit():
            return min(float(retry_after), 300.0)
        return min(self.backoff * self.factor ** (failed - 1), self.longest)


class Client:
    """Sends requests no closer than ``1 / per_second`` seconds to each other."""

    def __init__(self, retry: Retry = Retry(), timeout_ms: int = 30_000, per_second: float | None = None, headers: dict[str, str] | None = None):
        self.retry, self.timeout, self.headers = retry, timeout_ms / 1000, headers or {}
        self.gap, self.next = 1 / per_second if per_second else 0.0, 0.0

    def send(self, method: str, url: str, query: dict[str, object] | None = None, body: bytes | None = None, kind: str | None = None) -> bytes:
        """The answer's body. Network errors and statuses in RETRIED are tried again; others fail at once."""
        parts = urlsplit(url)
        url = urlunsplit(parts._replace(query=urlencode([*parse_qsl(parts.query, keep_blank_values=True), *(query or {}).items()])))
        headers = self.headers | ({"Content-Type": kind} if kind else {})
        for attempt in range(1, self.retry.attempts + 1):
            if (ahead := self.next - time.monotonic()) > 0:
                time.sleep(ahead)
            self.next = time.monotonic() + self.gap
            after = None
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method), timeout=self.timeout) as answer:
                    return answer.read()
            except urllib.error.HTTPError as e:
                problem, after = f"{method} {url}: status {e.code}", e.headers.get("Retry-After")
                if e.code not in RETRIED:
                    raise RuntimeError(problem) from e
            except OSError as e:
                problem = f"{method} {url}: {e}"
            if attempt < self.retry.attempts:
                time.sleep(self.retry.wait(attempt, after))
        raise RuntimeError(f"{problem}, after {self.retry.attempts} attempts")
