"""All queries of this subpackage, and their oracle SQL where SQL can say them."""

from folioforge.llm import (  # noqa: F401
    chat,
    decontam,
    importance,
    language,
    license,
    mixing,
    quality,
    repair,
    rules,
    scoring,
    sharding,
    simhash,
    toxicity,
)
from folioforge.llm.registry import ORACLES, QUERIES  # noqa: F401
