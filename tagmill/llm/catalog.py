"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import codes, collision, language, lines, minhash, mixing, personal, pieces, prefixes, quality, repair, vafile, whitening

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (vafile, mixing, language, minhash, quality, codes, lines, personal, collision, pieces, prefixes, repair, whitening):
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
