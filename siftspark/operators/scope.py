"""Scope: which URLs belong to a crawl that starts at a root."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U


def in_scope(candidate: Column, root: Column, cross_scheme: bool = True) -> Column:
    """Same host, and a path equal to the root's scope path or below it."""

    def inside(c: Column) -> Column:
        def of(r: Column) -> Column:
            base = U.scope_path(r["path"])
            same = c["host"] == r["host"]
            if not cross_scheme:
                same &= c["scheme"] == r["scheme"]
            return same & U.let(base, lambda b: (b == "/") | (c["path"] == b) | F.startswith(c["path"], F.concat(b, F.lit("/"))))

        return U.let(U.canonical(root), of)

    return F.coalesce(U.let(U.canonical(candidate), inside), F.lit(False))


def _valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


@dataclass(frozen=True)
class Scope:
    """A root with deny patterns (searched anywhere, any case; invalid ones are ignored) and query keys to strip."""

    root: str
    deny: tuple[str, ...] = ()
    strip_keys: tuple[str, ...] = ()
    strip_all: bool = False
    cross_scheme: bool = True

    def clean(self, url: Column) -> Column:
        """The canonical URL without the stripped keys, or null."""
        c = U.canonical(url, strip_query=self.strip_all)
        if not self.strip_keys or self.strip_all:
            return c["raw"]
        q = U.drop_keys(c["query"], list(self.strip_keys))
        return F.concat(c["scheme"], F.lit("://"), c["host"], c["path"], F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))

    def accept(self, url: Column) -> Column:
        if not self.root:
            return F.lit(False)
        out = in_scope(url, F.lit(self.root), self.cross_scheme)
        deny = [p for p in self.deny if _valid(p)]
        return out & ~F.coalesce(self.clean(url).rlike("(?i)" + "|".join(f"({p})" for p in deny)), F.lit(False)) if deny else out

    def filter_and_clean(self, url: Column) -> Column:
        return F.when(self.accept(url), self.clean(url))

    def score(self, url: Column) -> Column:
        """1 at the scope path and less below it; 0 outside."""
        return F.when(self.accept(url), U.let(U.canonical(url)["path"], lambda p: depth_score(p, U.scope_path(U.canonical(F.lit(self.root))["path"])))).otherwise(F.lit(0.0))


def depth_score(path: Column, scope: Column) -> Column:
    extra = F.size(F.filter(F.split(F.when(scope == "/", path).otherwise(F.substr(path, F.length(scope) + 1)), "/"), lambda s: s != ""))
    low = F.when(extra == 0, 1.0).when(extra == 1, 0.9).when(extra == 2, 0.7).otherwise(F.greatest(F.lit(0.3), F.lit(0.7) - F.lit(0.1) * extra))
    return F.when(scope == "/", F.greatest(F.lit(0.1), F.lit(1.0) / (F.lit(1.0) + extra))).otherwise(low)


def readmitted(links: DataFrame, root: str, found: int, rejected: Column) -> DataFrame:
    """The links of a first page: those in scope, or if there are none but some were rejected, all of the root's whole domain."""
    if found:
        return links.where(~rejected)
    whole = U.site_root(F.lit(root))
    return links.where(in_scope(F.col("dst"), whole))


def widened(a: Column, b: Column) -> Column:
    """The longest common run of leading segments of two paths: the scope that holds both."""
    pairs = F.zip_with(F.filter(F.split(a, "/"), lambda s: s != ""), F.filter(F.split(b, "/"), lambda s: s != ""), lambda x, y: F.when(x == y, x))
    gap = F.array_position(F.transform(pairs, lambda x: F.coalesce(x.isNull().cast("int"), F.lit(0))), 1).cast("int")
    return F.concat(F.lit("/"), F.array_join(F.when(gap > 0, F.slice(pairs, F.lit(1), gap - 1)).otherwise(pairs), "/"))
