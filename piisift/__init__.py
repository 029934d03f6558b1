"""piisift: personal-data detection, scrubbing and guarding as Spark jobs.

Public entry points (DataFrame in, DataFrame out):

* :func:`detect` -- merged matches per text (J1)
* :func:`scrub` -- masked text plus matches, never blocks (J2)
* :func:`guard` -- answer, score, block decision, matches, verdict (J3)
* :func:`hybrid_guard` -- the guard with model answers joined by ``doc_id`` (J10)
* :class:`DetectorConfig` -- allow-list, weights, threshold, opt-in NAME rules
"""

from piisift.config import DetectorConfig
from piisift.operators.detect import detect, explode_matches
from piisift.operators.guard import guard, hybrid_guard, scrub

__all__ = ["DetectorConfig", "detect", "explode_matches", "guard", "hybrid_guard", "scrub"]
