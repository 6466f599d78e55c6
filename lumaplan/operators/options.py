"""Options of decoders and encoders, and their faults as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumaplan.operators.errors import INVALID_ARGUMENT, OK, UNSUPPORTED, CodecError


@dataclass(frozen=True)
class DecoderOptions:
    """threads is accepted for callers that set it; Spark spreads the slices. strict parsing is the only kind. A frame size is given
    whole or not at all (0)."""

    threads: int = 0
    verify_crc: bool = True
    strict: bool = True
    width: int = 0
    height: int = 0

    def checked(self) -> DecoderOptions:
        if self.threads < 0:
            raise CodecError(INVALID_ARGUMENT, "the number of threads is not negative")
        if not self.strict:
            raise CodecError(UNSUPPORTED, "relaxed parsing is not implemented")
        if (self.width == 0) != (self.height == 0):
            raise CodecError(INVALID_ARGUMENT, "width and height are both set or both 0")
        return self


@dataclass(frozen=True)
class EncoderOptions:
    threads: int = 0
    version: int = 3
    entropy: str = "range"
    keyframe_interval: int = 1

    def checked(self) -> EncoderOptions:
        if self.threads < 0:
            raise CodecError(INVALID_ARGUMENT, "the number of threads is not negative")
        if self.keyframe_interval < 1:
            raise CodecError(INVALID_ARGUMENT, "the keyframe interval is at least 1")
        return self


def decoder_option_code(threads: Column, strict: Column, width: Column, height: Column) -> Column:
    """The status code of DecoderOptions.checked() for each row."""
    return F.when(threads < 0, INVALID_ARGUMENT).when(~strict, UNSUPPORTED).when((width == 0) != (height == 0), INVALID_ARGUMENT).otherwise(OK)


def encoder_option_code(threads: Column, keyframe_interval: Column) -> Column:
    return F.when((threads < 0) | (keyframe_interval < 1), INVALID_ARGUMENT).otherwise(OK)
