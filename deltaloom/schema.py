"""Options, the patch layout and errors.

"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the patch layout.
MAGIC = 0xB1DF
VERSION = 0x2000
HEADER = "<IIQI"  # magic, version, new_size, num_chunks
RECORD = "<QQQQQ"  # old_start, new_start, new_len, raw_len, data_len

CHUNK_ROW = (
    "old_start long, new_start long, new_len long, raw_len long, data_len long, data binary"
)


class PatchDecodeError(ValueError):
    """A patch, or a control stream in it, that can't be decoded. [A8]"""


class WrongMagic(PatchDecodeError):
    pass


class WrongVersion(PatchDecodeError):
    pass


@dataclass(frozen=True)
class DiffOptions:
    """[D11, F14] block_size: bytes of an indexed block. chunk_size: bytes of a scan chunk,
    None for one chunk. zstd_level: 3 by default, 22 for the smallest patches. [C6]
    """

    block_size: int = 32
    chunk_size: int | None = 1 << 20
    zstd_level: int = 3

    def __post_init__(self) -> None:
        if self.block_size < 4:
            raise ValueError("block size must be at least 4")
        if self.chunk_size is not None and self.chunk_size < 1:
            raise ValueError("scan chunk size must be at least 1")
