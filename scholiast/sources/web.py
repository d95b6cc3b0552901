"""PDFs behind URLs as a Python data source: one partition per URL, guarded by an explicit option."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, content binary, error string"


class _Url(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.most = int(options.get("max_bytes", 80 * 2**20))
        self.redirects = int(options.get("max_redirects", 5))
        self.allowed = options.get("network", "false").lower() == "true"

    def partitions(self) -> list[_Url]:
        return [_Url(u) for u in self.urls]

    def read(self, part: _Url) -> Iterator[tuple]:
        yield (part.url, *self._fetch(part.url))

    def _fetch(self, url: str) -> tuple[bytes | None, str | None]:
        """(content, error); the error never holds the address."""
        import urllib.error
        import urllib.request

        most, hops = self.most, self.redirects

        class Redirects(urllib.request.HTTPRedirectHandler):
            max_redirections = hops

            def redirect_request(self, req, fp, code, msg, headers, newurl):  # noqa: ANN001, ANN202
                if not newurl.startswith(("http://", "https://")):
                    raise urllib.error.URLError("redirect to another scheme")
                return super().redirect_request(req, fp, code, msg, headers, newurl)

        if not self.allowed:
            return None, "network is off; set the option network to true"
        if not url.startswith(("http://", "https://")):
            return None, "only http and https"
        try:
            with urllib.request.build_opener(Redirects).open(url, timeout=45) as r:
                body = r.read(most + 1)
        except OSError as e:
            return None, f"download failed: {type(e).__name__}"
        if len(body) > most:
            return None, f"larger than {most} bytes"
        return (body, None) if body.startswith(b"%PDF-") else (None, "no PDF")


class PdfUrls(DataSource):
    """spark.dataSource.register(PdfUrls); spark.read.format("pdf_urls").option("urls", ...).option("network", "true").load()"""

    @classmethod
    def name(cls) -> str:
        return "pdf_urls"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)
