"""A session's search: its results, a view of them, and the row that is selected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import search as se
from . import similar as si
from .stats import ranked


class SearchRunner:
    """Runs searches over ``samples``. Results stay a DataFrame, numbered from 1 in their
    order; only the rows of a view come to the driver."""

    def __init__(self, samples: DataFrame, view: int = 500) -> None:
        self.samples, self.view = samples, view
        self.found: DataFrame | None = None
        self.total = self.selection = 0
        self._before: tuple[DataFrame, int, int] | None = None

    def _show(self, found: DataFrame, total: int, selection: int = 0) -> None:
        self.found, self.total = found, total
        self.select(selection)

    def run(self, query: se.SearchQuery | str, limit: int = 0) -> int:
        """Searches anew and returns the number of results; a similarity view is left."""
        found = ranked(se.search(self.samples, query, limit), [F.col("path")])
        self._before = None
        self._show(found, found.count(), self.selection)
        return self.total

    def select(self, at: int) -> int:
        """Selects the row ``at`` from 0, or the nearest that there is."""
        self.selection = max(0, min(at, self.total - 1))
        return self.selection

    def move(self, step: int) -> int:
        return self.select(self.selection + step)

    def snapshot(self, first: int = 0) -> list[Row]:
        """The results from number ``first`` (from 0) on, ``view`` at most."""
        if self.found is None:
            return []
        return self.found.filter(F.col("place").between(first + 1, first + self.view)).orderBy("place").collect()

    def selected(self) -> Row | None:
        return self.found.filter(F.col("place") == self.selection + 1).first() if self.total else None

    def enter_similarity(self, vectors: DataFrame, subject: int, limit: int = 50) -> int:
        """Shows the rows most similar to ``subject`` instead, at most ``view``."""
        if self._before is None and self.found is not None:
            self._before = (self.found, self.total, self.selection)
        scores = si.similar(vectors, subject, min(limit, self.view))
        near = self.samples.join(F.broadcast(scores.select("path", "sim", "dist")), "path")  # ``view`` rows at most
        found = ranked(near, [(F.col("id") == subject).desc(), F.col("dist"), F.col("id")])
        self._show(found, found.count())
        return self.total

    def leave_similarity(self) -> None:
        """Back to the results and the selection from before."""
        if self._before is not None:
            self._show(*self._before)
            self._before = None
