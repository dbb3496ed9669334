"""From a request to DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.metrics import NUTRIENTS
from larder.operators import filters
from larder.operators.facets import category_hits
from larder.operators.ordering import page, ranked, sort_columns
from larder.operators.search import SearchIndex, search
from larder.plans.request import CatalogQuery, number


def filtered(products: DataFrame, request: CatalogQuery, index: SearchIndex | None = None, compared: DataFrame | None = None) -> DataFrame:
    """All predicates but the category. Column predicates come first and reach the scan; searches and comparisons are
    semi joins on what is left."""
    keep = filters.in_store(request.store)
    if request.brand:
        keep &= filters.of_brand(request.brand)
    if request.discount_only:
        keep &= filters.discounted()
    if request.complete_only:
        keep &= filters.complete()
    if request.hide_pets:
        keep &= filters.no_pets()
    if request.in_stock_only:
        keep &= filters.in_stock()
    if request.plausible_only:
        keep &= filters.plausible()
    if (least := number(request.min_density)) is not None:
        keep &= filters.dense(least)
    keep &= filters.between("price", *map(number, request.price))
    for n in NUTRIENTS:
        keep &= filters.between(n, *request.bounds(n))
    rows = products.where(keep)
    if request.cheaper_only and compared is not None:
        rows = filters.cheaper_elsewhere(rows, compared)
    if request.query.strip() and index is not None:
        rows = search(rows, index, request.query)
    return rows


@dataclass(frozen=True)
class Answer:
    """What a request finds. Nothing is sorted or written before rows() asks for it, so a facet costs a filter and a count."""

    found: DataFrame
    request: CatalogQuery

    def hits(self) -> DataFrame:
        """(cat, hits) over all categories."""
        return category_hits(self.found)

    def rows(self, limit: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """The rows of the requested category in order: with a limit a distributed top-k, else all, or ``columns`` of them,
        with their rank."""
        chosen = self.found if self.request.category == "all" else self.found.where(F.col("cat") == self.request.category)
        order = sort_columns(*self.request.sort, self.request.basis)
        if limit is None:
            return ranked(chosen, order, columns)
        first = page(chosen, order, limit)
        return first.select(*columns) if columns else first


def run(products: DataFrame, request: CatalogQuery, index: SearchIndex | None = None, compared: DataFrame | None = None) -> Answer:
    return Answer(filtered(products, request, index, compared), request)
