"""Cost formulas of model calls, in US dollars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _n(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def by_catalogue(prompt: Column, completion: Column, p_price: Column, c_price: Column, request: Column, cache_write: Column, w_price: Column, cache_read: Column, r_price: Column) -> Column:
    """Prices for one token, and one for the request; what is null counts as 0."""
    return _n(request) + _n(prompt) * _n(p_price) + _n(completion) * _n(c_price) + _n(cache_write) * _n(w_price) + _n(cache_read) * _n(r_price)


def with_cache(prompt: Column, completion: Column, p_price: Column, c_price: Column, cache_write: Column, cache_read: Column) -> Column:
    """Prices for a million tokens; writing to the cache costs a quarter more, reading a tenth. 0 without both prices."""
    total = _n(prompt) * p_price + _n(completion) * c_price + _n(cache_write) * p_price * 1.25 + _n(cache_read) * p_price * 0.1
    return F.when((_n(p_price) != 0) & (_n(c_price) != 0), total / 1_000_000).otherwise(F.lit(0.0))


def plain(prompt: Column, completion: Column, p_price: Column, c_price: Column) -> Column:
    """Prices for a million tokens, caches aside. 0 without both prices."""
    return F.when((_n(p_price) != 0) & (_n(c_price) != 0), (_n(prompt) * p_price + _n(completion) * c_price) / 1_000_000).otherwise(F.lit(0.0))
