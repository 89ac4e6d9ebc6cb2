"""All registered queries with their check SQL."""

from __future__ import annotations

from functools import cache

from cartwave.registry.base import Registry


@cache
def registry() -> Registry:
    from cartwave.registry import learning, purchase, signal

    r = Registry()
    purchase.register(r)
    signal.register(r)
    learning.register(r)
    return r
