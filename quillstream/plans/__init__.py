"""The query catalogue: each query with its SQL oracle."""

from . import finding, further, gathering, helpers, keeping, more, pages, reads, texts, traffic

QUERIES, ORACLE = {}, {}
for part in (reads, texts, traffic, more, further, pages, finding, gathering, keeping, helpers):
    QUERIES |= part.QUERIES
    ORACLE |= part.ORACLE
