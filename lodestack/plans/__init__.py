"""Named query plans; importing this package fills the registry."""

from lodestack.plans import analytics, clusters, decoding, feed, manifests, payloads, programs, queue, relations, remote, states, text, values  # noqa: F401
from lodestack.plans.registry import ORACLES, QUERIES  # noqa: F401
