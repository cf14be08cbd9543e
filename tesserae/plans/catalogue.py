"""Registered queries of the reference's operators and the SQL that they are compared with."""

from tesserae.plans import q_attribution, q_mining, q_relational

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (q_relational, q_mining, q_attribution):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
