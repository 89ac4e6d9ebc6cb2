"""Which months feed the features, which month gives the label, and file names."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Window:
    feature_months: tuple[int, ...]
    label_month: int | None = None

    @property
    def name(self) -> str:
        return "".join(str(m) for m in self.feature_months)


# fixed values: the windows used for training, testing and final scoring,
# and the single-month test windows
TRAIN = Window((2, 3, 4), 5)
TEST = Window((4, 5, 6), 7)
SCORE = Window((5, 6, 7), None)
TEST_MONTH_5 = Window((5,), 6)
TEST_MONTH_7 = Window((7,), 8)
WINDOWS = (TEST, TRAIN, SCORE)
TEST_WINDOWS = (TEST_MONTH_5, TEST_MONTH_7)

# fixed values: table name of each dataset
DATASETS = {
    "user_item": "ui",
    "user": "u",
    "user_brand": "ub",
    "user_cat": "uc",
    "spend": "ua",
}
