"""Imports every operator module, so that the registry is complete."""

from __future__ import annotations

from seqloom.llm import bpe, decontaminate, htmltext, jaccard, langid, linededup, lm, mining, neighbours, packing, repeats, resampling, secrets  # noqa: F401
from seqloom.llm.common import ORACLES, QUERIES  # noqa: F401
