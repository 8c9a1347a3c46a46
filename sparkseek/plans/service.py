"""The request surface: search pages as JSON, suggestions, and stored documents."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.text import query_words
from ..operators import search, suggest
from ..operators.index import Index


@dataclass
class SearchService:
    """Answers requests from materialised tables; each request is one lazily built plan.

    index: postings, norms and frequencies; ranks (doc_id, pagerank); pages (page_id, url, html);
    ngrams: counts of `suggest.ngram_counts`.
    """

    index: Index
    ranks: DataFrame
    pages: DataFrame
    ngrams: DataFrame | None = None

    def search(self, query: str, number: int = 1, strict: bool = False) -> str:
        """{"data": [{title, url, description}], "total": n} of a result page; pages beyond the end are empty."""
        scored = search.scores(self.index, self.ranks, query_words(query))
        # The page is cut before any page body is read.
        hits = search.page(scored, number, strict=strict)
        return search.to_json(search.results(hits, self.pages, query), scored).first()["json"]

    def shown(self, query: str, number: int = 1) -> list[dict]:
        """A result page as displayed: cut and highlighted."""
        scored = search.scores(self.index, self.ranks, query_words(query))
        rows = search.results(search.page(scored, number), self.pages, query)
        return [r.asDict() for r in search.display(rows.orderBy(*search.order()), query).collect()]

    def suggest(self, typed: str) -> list[str]:
        """Up to five continuations of the input."""
        if self.ngrams is None:
            return []
        return [r["suggestion"] for r in suggest.suggest(self.ngrams, typed).orderBy("rank").collect()]

    def total(self, query: str) -> int:
        return json.loads(self.search(query))["total"]
