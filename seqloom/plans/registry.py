"""Imports every plan module, so that the registry is complete."""

from __future__ import annotations

from seqloom.plans import (  # noqa: F401
    blocks, descriptors, event_sequences, features, modelling, searching, training,
)
from seqloom.plans.base import ORACLES, QUERIES  # noqa: F401


def flagship(spark, folder):
    return QUERIES["label_feature_means"](spark, folder)
