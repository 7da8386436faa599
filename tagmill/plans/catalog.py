"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import duplicates, evaluation, hits, labelling, lists, manifests, merging, reports, scalars, streams, suppression, video

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (evaluation, labelling, duplicates, merging, video, scalars, streams, manifests, reports, suppression, hits, lists):
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
