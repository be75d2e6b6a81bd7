"""tokenmill: a Spark-native text-corpus engine.

Turns text tables into masked-language-model training data and metrics:
vocabulary building, normalisation and subword encoding, fixed-length
sequence packing, keyed-hash masking, shard assignment and shuffling,
sentence-pair preparation, batch scoring and loss / accuracy metrics.

Every operator is ``DataFrame -> DataFrame`` or ``Column -> Column``.
"""

from tokenmill.config import Config, DataConfig, MaskingConfig, TokenizerConfig  # noqa: F401

__all__ = ["Config", "DataConfig", "MaskingConfig", "TokenizerConfig"]
