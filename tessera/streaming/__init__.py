"""Streaming: the reference has no streaming operator.

The one thing a user of the batch library needs on a stream is to score it
with a pipeline fitted in batch (M9 applied to ``readStream`` input).
Fitted Spark ML pipelines - including this library's stages, which only
compose column expressions - are stateless per row, so ``transform`` works on
a streaming DataFrame unchanged.
"""

from tessera.streaming.scoring import score_stream, start_scoring

__all__ = ["score_stream", "start_scoring"]
