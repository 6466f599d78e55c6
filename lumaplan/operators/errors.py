"""Failures carry a code and, where known, the place: byte, frame and slice."""

from __future__ import annotations

# The public status codes, in order.
OK, INVALID_ARGUMENT, INVALID_STATE, SYNTAX, UNSUPPORTED, CRC_MISMATCH, EXHAUSTED, INTERNAL, NOT_IMPLEMENTED = range(9)

STATUS = "struct<code:int,message:string,byte_offset:bigint,frame_index:bigint,slice_index:int>"


class CodecError(ValueError):
    def __init__(self, code: int, message: str, byte_offset: int | None = None, frame_index: int | None = None, slice_index: int | None = None):
        super().__init__(message)
        self.code, self.message, self.byte_offset, self.frame_index, self.slice_index = code, message, byte_offset, frame_index, slice_index

    def at(self, **place: int) -> CodecError:
        """Fills in what of the place is not known yet."""
        for k, v in place.items():
            if getattr(self, k) is None:
                setattr(self, k, v)
        return self

    def status(self) -> dict:
        return {"code": self.code, "message": self.message, "byte_offset": self.byte_offset, "frame_index": self.frame_index, "slice_index": self.slice_index}


def ok_status() -> dict:
    return {"code": OK, "message": "", "byte_offset": None, "frame_index": None, "slice_index": None}
