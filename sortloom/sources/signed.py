"""Objects through signed URLs: requests that carry their permission in the query, for a limited time.

S3 (`s3://bucket/key`) is signed with AWS4-HMAC-SHA256, Google's store (`gs://bucket/key`, with an HMAC key) with
GOOG4-HMAC-SHA256; both sign the same canonical request. Keys come from the environment: AWS_ACCESS_KEY_ID,
AWS_SECRET_ACCESS_KEY, AWS_SESSION_TOKEN and AWS_REGION, or GOOG_ACCESS_KEY_ID and GOOG_SECRET_ACCESS_KEY.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import time
import urllib.error
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

#: Seconds that a URL is good for, and the most that a request for it waits for the store to answer.
EXPIRES, ANSWER = 3600, 60.0
#: Tries of an upload, and seconds before the second one; the pause doubles.
TRIES, PAUSE = 8, 0.5


@dataclass(frozen=True)
class Scheme:
    """Fixed values of a kind of signature."""

    name: str
    header: str
    service: str
    end: str
    host: str
    env: str


SCHEMES = {
    "s3": Scheme("AWS4", "X-Amz", "s3", "aws4_request", "{bucket}.s3.{region}.amazonaws.com", "AWS"),
    "gs": Scheme("GOOG4", "X-Goog", "storage", "goog4_request", "{bucket}.storage.googleapis.com", "GOOG"),
}


def signed_url(method: str, url: str, expires: int = EXPIRES, at: datetime | None = None, env: Mapping[str, str] = os.environ, host: str | None = None, endpoint: str | None = None) -> str:
    """A URL that allows `method` on an object. host: in place of the store's own; endpoint: scheme and authority of another server, with buckets in its paths."""
    kind, _, rest = url.partition("://")
    scheme = SCHEMES["s3" if kind == "s3a" else kind]
    bucket, _, key = rest.partition("/")
    region = env.get("AWS_REGION", "us-east-1") if scheme.env == "AWS" else "auto"
    path = "/" + quote(key, safe="/-_.~")
    if endpoint:
        host, path = urlsplit(endpoint).netloc, f"/{bucket}{path}"
    host = host or scheme.host.format(bucket=bucket, region=region)
    now = at or datetime.now(UTC)
    stamp, day = now.strftime("%Y%m%dT%H%M%SZ"), now.strftime("%Y%m%d")
    scope = f"{day}/{region}/{scheme.service}/{scheme.end}"
    query = {"Algorithm": f"{scheme.name}-HMAC-SHA256", "Credential": f"{env[f'{scheme.env}_ACCESS_KEY_ID']}/{scope}", "Date": stamp, "Expires": str(expires), "SignedHeaders": "host"}
    if scheme.env == "AWS" and env.get("AWS_SESSION_TOKEN"):
        query["Security-Token"] = env["AWS_SESSION_TOKEN"]
    asked = "&".join(f"{quote(f'{scheme.header}-{k}', safe='-_.~')}={quote(v, safe='-_.~')}" for k, v in sorted(query.items()))
    request = "\n".join([method, path, asked, f"host:{host}", "", "host", "UNSIGNED-PAYLOAD"])
    text = "\n".join([f"{scheme.name}-HMAC-SHA256", stamp, scope, hashlib.sha256(request.encode()).hexdigest()])
    secret = f"{scheme.name}{env[f'{scheme.env}_SECRET_ACCESS_KEY']}".encode()
    for part in (day, region, scheme.service, scheme.end):
        secret = hmac.new(secret, part.encode(), hashlib.sha256).digest()
    signature = hmac.new(secret, text.encode(), hashlib.sha256).hexdigest()
    return f"{endpoint or f'https://{host}'}{path}?{asked}&{scheme.header}-Signature={signature}"


class Download:
    """An object as a file that is opened at a place: a request for what follows it."""

    def __init__(self, url: str, endpoint: str | None = None):
        self.url, self.endpoint, self.answer = url, endpoint, None

    def __enter__(self):
        return self

    def __exit__(self, *failed):
        if self.answer is not None:
            self.answer.close()

    def seek(self, at: int) -> None:
        request = urllib.request.Request(signed_url("GET", self.url, endpoint=self.endpoint), headers={"Range": f"bytes={at}-"})
        self.answer = urllib.request.urlopen(request, timeout=ANSWER)
        if at and self.answer.status != 206:
            raise OSError(f"{self.url}: the store ignores ranges")

    def read(self, n: int) -> bytes:
        return self.answer.read(n)


class SignedUpload:
    """An object that is sent whole when it is closed, and again if that fails; it is held in memory until then."""

    def __init__(self, url: str, timeout: float, endpoint: str | None = None):
        self.url, self.timeout, self.endpoint, self.parts = url, timeout, endpoint, []

    def write(self, data) -> None:
        self.parts.append(bytes(memoryview(data)))

    def close(self) -> None:
        body, pause = b"".join(self.parts), PAUSE
        self.parts = []
        for left in reversed(range(TRIES)):
            try:
                request = urllib.request.Request(signed_url("PUT", self.url, endpoint=self.endpoint), data=body, method="PUT")
                urllib.request.urlopen(request, timeout=self.timeout).close()
                return
            except OSError as e:  # HTTP errors and timeouts are some
                refused = isinstance(e, urllib.error.HTTPError) and 400 <= e.code < 500 and e.code not in (408, 429)
                if not left or refused:
                    raise
                time.sleep(pause)
                pause *= 2
