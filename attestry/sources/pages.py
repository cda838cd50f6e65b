"""Pages: the ingestion edge. Fetching is pluggable; a snapshot is any table ``url, html``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fetched(urls: DataFrame, fetch: Callable[[str], str]) -> DataFrame:
    """``url, html, error`` by a given fetcher, once for each address; errors become rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for url in part["url"]:
                try:
                    rows.append((url, fetch(url), None))
                except Exception as e:  # noqa: BLE001 - any failure of a page is its own row
                    rows.append((url, None, str(e)))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    return urls.select("url").dropna().distinct().mapInPandas(run, "url string, html string, error string")
