"""Wide profiles per entity and per user-entity pair.

All families of a profile come from one base cube.  Each pair table is grouped
from the cube once, each entity summary from its pair table once, and summaries of
the same entity share one partitioning when they are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cartwave.functions.columns import zero_nulls
from cartwave.operators import families as fam
from cartwave.operators.cube import roll, summary

LETTER = {"user_id": "u", "brand_id": "b", "cat_id": "c", "item_id": "i"}
ENTITY = {"brand": "brand_id", "cat": "cat_id", "item": "item_id", "user": "user_id"}


class Profiles:
    """Profile builders over one cube (or monthly facts) and its months."""

    def __init__(self, facts: DataFrame, months: Sequence[int]):
        self.facts = facts
        self.months = list(months)

    # -- building blocks -------------------------------------------------

    def pairs(self, a: str, b: str) -> DataFrame:
        return roll(self.facts, [a, b], self.months)

    def summary(self, entity: str, other: str) -> DataFrame:
        return summary(self.pairs(*sorted((entity, other))), entity, other, self.months)

    def rolled(self, *keys: str) -> DataFrame:
        out = roll(self.facts, keys, self.months)
        for k in keys:
            out = out.where(F.col(k).isNotNull())
        return out

    def user_summary(self, attribute: str, repeat: bool = False) -> DataFrame:
        """Users over one attribute; ``repeat`` adds the buyer-days of all users."""
        out = self.summary("user_id", ENTITY[attribute])
        if not repeat:
            return out
        # the total runs as a scalar subquery, not as a join
        total = out.agg(F.coalesce(F.sum("day_sum"), F.lit(0)).alias("t")).scalar()
        return out.withColumn("all_user_days", total)

    # -- single families -------------------------------------------------

    def activity(self, *keys: str, ols: bool = False) -> DataFrame:
        prefix = fam.PREFIX[keys]
        return self.rolled(*keys).selectExpr(*keys, *fam.activity(prefix, self.months, ols))

    def activity_stats(
        self, *keys: str, months_only: bool = False, stats: Sequence[str] = fam.STATS
    ) -> DataFrame:
        prefix = fam.PREFIX[keys]
        return self.rolled(*keys).selectExpr(
            *keys, *fam.activity_stats(prefix, self.months, months_only, stats)
        )

    def _diversity(self, entity: str, attributes: Sequence[str], columns) -> DataFrame:
        out = None
        for a in attributes:
            part = self.summary(entity, ENTITY[a]).selectExpr(entity, *columns(a))
            out = part if out is None else out.join(part, entity)
        return out

    def diversity(self, entity: str) -> DataFrame:
        letter = LETTER[entity]
        return self._diversity(
            entity,
            fam.DIVERSITY[entity],
            lambda a: fam.diversity(letter, a, self.months),
        )

    def diversity_stats(
        self, entity: str, months_only: bool = False, stats: Sequence[str] = fam.STATS
    ) -> DataFrame:
        letter = LETTER[entity]
        return self._diversity(
            entity,
            fam.DIVERSITY_STATS[entity],
            lambda a: fam.diversity_stats(letter, a, self.months, months_only, stats),
        )

    def penetration(self, entity: str) -> DataFrame:
        return self.summary(entity, "user_id").selectExpr(
            entity, *fam.penetration(LETTER[entity], self.months)
        )

    def penetration_stats(self, entity: str, stats: Sequence[str] = fam.STATS) -> DataFrame:
        return self.summary(entity, "user_id").selectExpr(
            entity, *fam.penetration_stats(LETTER[entity], self.months, stats)
        )

    def over_users(self, entity: str) -> DataFrame:
        """Statistics of an entity's users; entities with no known user are absent."""
        return (
            self.summary(entity, "user_id")
            .where(F.col("partners") > 0)
            .selectExpr(entity, *fam.partner_stats())
        )

    def user_over(self, attribute: str) -> DataFrame:
        """Statistics of a user's items, brands or categories."""
        return (
            self.summary("user_id", ENTITY[attribute])
            .where(F.col("partners") > 0)
            .selectExpr("user_id", *fam.partner_stats(f"{attribute[0]}_"))
        )

    def repeat_entity(self, entity: str) -> DataFrame:
        return self.summary(entity, "user_id").selectExpr(
            entity, *fam.repeat_of_entity(LETTER[entity])
        )

    def repeat_user(self, attributes: Sequence[str] = ("item", "brand", "cat")) -> DataFrame:
        out = None
        for a in attributes:
            part = self.user_summary(a, repeat=True).selectExpr(
                "user_id", *fam.repeat_of_user(a)
            )
            out = part if out is None else out.join(part, "user_id")
        return out

    # -- profiles --------------------------------------------------------

    def items(self) -> DataFrame:
        return self._items().drop(*self._over_users_columns())

    def _items(self) -> DataFrame:
        m = self.months
        return self.summary("item_id", "user_id").selectExpr(
            "item_id",
            *fam.activity_stats("i_", m),
            *fam.activity("i_", m),
            *fam.penetration_stats("i", m),
            *fam.penetration("i", m),
            *fam.repeat_of_entity("i"),
            *fam.partner_stats(),
        )

    @staticmethod
    def _over_users_columns() -> list[str]:
        return [f"{n}_{s}" for n in ("day", "sldat", "amt") for s in fam.STATS]

    def _group_profile(self, entity: str) -> DataFrame:
        """Brand or category profile, plus statistics over its users."""
        m, letter = self.months, LETTER[entity]
        out = self.summary(entity, "user_id").selectExpr(
            entity,
            *fam.activity_stats(f"{letter}_", m),
            *fam.activity(f"{letter}_", m),
            *fam.penetration_stats(letter, m),
            *fam.penetration(letter, m),
            *fam.repeat_of_entity(letter),
            *fam.partner_stats(),
        )
        for a in fam.DIVERSITY[entity]:
            part = self.summary(entity, ENTITY[a]).selectExpr(
                entity, *fam.diversity_stats(letter, a, m), *fam.diversity(letter, a, m)
            )
            out = out.join(part, entity)
        return out

    def brands(self) -> DataFrame:
        return self._group_profile("brand_id").drop(*self._over_users_columns())

    def cats(self) -> DataFrame:
        return self._group_profile("cat_id").drop(*self._over_users_columns())

    def users(self, over: Sequence[str] = (), repeat: Sequence[str] = ()) -> DataFrame:
        """User profile, with statistics over and repeats of chosen attributes."""
        m, out = self.months, None
        for a in fam.DIVERSITY["user_id"]:
            cols: list[str] = []
            if out is None:
                cols += fam.activity_stats("u_", m) + fam.activity("u_", m)
            cols += fam.diversity("u", a, m)
            if a in fam.DIVERSITY_STATS["user_id"]:
                cols += fam.diversity_stats("u", a, m)
            if a in over:
                cols += fam.partner_stats(f"{a[0]}_")
            if a in repeat:
                cols += fam.repeat_of_user(a)
            part = self.user_summary(a, a in repeat).selectExpr("user_id", *cols)
            out = part if out is None else out.join(part, "user_id")
        return out

    def user_pairs(self, attribute: str, label: DataFrame | None = None) -> DataFrame:
        """Pair statistics enriched with the user's and the entity's profile.

        The label joins the narrow pair table first, on the pair key.
        """
        entity = ENTITY[attribute]
        pairs = self.activity_stats("user_id", entity)
        if label is not None:
            pairs = pairs.join(label, ["user_id", entity], "left").fillna(0, ["target"])
        users = self.users(over=(attribute,), repeat=(attribute,))
        things = self._items() if attribute == "item" else self._group_profile(entity)
        # sizes are known when the profiles are done: Spark then broadcasts a small side or splits a hot user's or entity's rows
        out = pairs.join(users, "user_id", "left").join(things, entity, "left")
        order = ["user_id", entity]
        return zero_nulls(out.select(*order, *[c for c in out.columns if c not in order]), keep=("user_id", entity))
