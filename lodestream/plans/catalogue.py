"""The registered queries of the engine and their SQL."""

from lodestream.plans import documents, market, replies, serving

QUERIES: dict = {**market.Q, **documents.Q, **serving.Q, **replies.Q}
ORACLES: dict = {**market.SQL, **documents.SQL, **serving.SQL, **replies.SQL}
