"""Run configuration as frozen dataclasses.

Fixed values (must equal the behaviour being reproduced):
  max characters per word 50, minimum token frequency 500, alphabet of 100,
  vocabulary size 32768, sequence size 128, 100,000 sequences per raw file,
  100 shards, masking probabilities mask 0.12 / random 0.015 / keep 0.015,
  pretraining batch 128, fine-tune batch 16, 5 fine-tune epochs,
  32 peak accumulated batches.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field


@dataclass(frozen=True)
class MaskingConfig:
    mask_p: float = 0.12
    random_p: float = 0.015
    keep_p: float = 0.015

    def __post_init__(self):
        total = self.mask_p + self.random_p + self.keep_p
        if not (0.0 <= total <= 1.0) or min(self.mask_p, self.random_p, self.keep_p) < 0:
            raise ValueError(f"masking shares must not be negative nor sum to more than 1: mask {self.mask_p}, random {self.random_p}, keep {self.keep_p}")


@dataclass(frozen=True)
class TokenizerConfig:
    max_chars_per_word: int = 50
    min_token_frequency: int = 500
    max_alphabet_size: int = 100
    vocab_size: int = 32768
    fix_text: bool = False


@dataclass(frozen=True)
class DataConfig:
    download_file_size: int = 100_000
    num_shards: int = 100
    sequence_size: int = 128
    vocab_size: int = 32768
    masking: MaskingConfig = field(default_factory=MaskingConfig)

    def __post_init__(self):
        if self.vocab_size > 65535:
            raise ValueError("vocabulary must fit 16-bit ids")
        if not 0 < self.num_shards <= 255:
            raise ValueError("shard numbers must fit 8 bits")


@dataclass(frozen=True)
class TrainingConfig:
    batch_size: int = 128
    peak_batches_accumulated: int = 32


@dataclass(frozen=True)
class TuningConfig:
    batch_size: int = 16
    epochs: int = 5


@dataclass(frozen=True)
class Config:
    tokenizer: TokenizerConfig = field(default_factory=TokenizerConfig)
    data: DataConfig = field(default_factory=DataConfig)
    training: TrainingConfig = field(default_factory=TrainingConfig)
    tuning: TuningConfig = field(default_factory=TuningConfig)

    def replace(self, **sections) -> "Config":
        """Override whole sections or ``section__key`` values; unknown keys raise."""
        updates: dict = {}
        for key, value in sections.items():
            if "__" in key:
                section, name = key.split("__", 1)
                current = updates.get(section, getattr(self, section))
                if name not in {f.name for f in dataclasses.fields(current)}:
                    raise KeyError(f"unknown config key {key}")
                updates[section] = dataclasses.replace(current, **{name: value})
            else:
                if key not in {f.name for f in dataclasses.fields(self)}:
                    raise KeyError(f"unknown config section {key}")
                updates[key] = value
        return dataclasses.replace(self, **updates)
