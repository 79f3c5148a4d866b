"""Default clients over public client libraries; imported only where the library is there."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator
from typing import Any

from millrace.functions import codecs


class prometheus:  # noqa: N801  named by kind
    """Instant queries over HTTP."""

    def __init__(self, config: Any):
        self.config = config

    def read(self, partition: dict) -> Iterator[dict]:
        c = self.config
        query = {"query": c.query, **({"time": c.time} if c.time else {})}
        url = f"{c.endpoint.rstrip('/')}/api/v1/query?{urllib.parse.urlencode(query)}"
        with urllib.request.urlopen(url, timeout=c.read_timeout_ms / 1000) as answer:  # noqa: S310
            yield from codecs.prometheus_rows(json.load(answer))


class ftp:  # noqa: N801
    """Byte ranges of remote files, and uploads under a temporary name."""

    def __init__(self, config: Any):
        import ftplib

        c = self.config = config
        self.ftp = ftplib.FTP(timeout=c.timeout_millis / 1000)  # noqa: S321
        self.ftp.connect(c.host, c.port)
        self.ftp.login(c.user or "anonymous", c.password)

    def files(self) -> list[tuple[str, int]]:
        names = self.ftp.nlst(self.config.path)
        self.ftp.voidcmd("TYPE I")
        return [(n, self.ftp.size(n)) for n in names]

    def read_at(self, name: str, at: int, size: int) -> bytes:
        out = bytearray()
        with self.ftp.transfercmd(f"RETR {name}", rest=at) as connection:
            while len(out) < size and (data := connection.recv(size - len(out))):
                out += data
        self.ftp.abort()
        return bytes(out)

    def upload(self, name: str, data: bytes) -> None:
        import io

        self.ftp.storbinary(f"STOR {name}.tmp", io.BytesIO(data))
        self.ftp.rename(f"{name}.tmp", name)

    def close(self) -> None:
        self.ftp.close()
