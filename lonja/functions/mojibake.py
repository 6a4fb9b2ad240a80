"""Repair of UTF-8 text that was once read as Windows-1252.

One layer is undone and only where the result is valid UTF-8. The column expressions stay in the JVM; ``repair`` is the
same for one Python string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lonja.functions.text import as_col, bind

#: Characters that give damaged text away (fixed values).
HINTS = "ÃÂâÐÑÅ�€™"


def _byte_of() -> dict[str, int]:
    """Character to byte as browsers read Windows-1252: the five bytes that Python leaves undefined are C1 controls."""
    table = {}
    for byte in range(256):
        try:
            table[bytes([byte]).decode("cp1252")] = byte
        except UnicodeDecodeError:
            table[chr(byte)] = byte
    return table


_BYTE_OF = _byte_of()


def repair(text: str) -> str:
    try:
        return bytes(map(_BYTE_OF.__getitem__, text)).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return text


_CHAR_OF = {byte: char for char, byte in _BYTE_OF.items()}
#: The characters that Windows-1252 has at bytes where Latin-1 has controls, and those controls.
_OWN = "".join(char for char, byte in _BYTE_OF.items() if ord(char) != byte)
_CONTROLS = "".join(chr(byte) for char, byte in _BYTE_OF.items() if ord(char) != byte)
#: Anything that Windows-1252 cannot write.
_FOREIGN = "[^" + "".join(f"\\x{{{ord(char):X}}}" for char in _BYTE_OF) + "]"


def damage(value: Column | str) -> Column:
    """The text as it looks after its UTF-8 bytes were read as Windows-1252; for tests of the repair."""
    return F.translate(F.decode(F.encode(as_col(value), "UTF-8"), "ISO-8859-1"), _CONTROLS, _OWN)


def repair_text(value: Column | str) -> Column:
    """The repaired text; null and clean text pass through."""
    value = as_col(value)
    damaged = value.rlike(f"[{HINTS}]") & ~value.rlike(_FOREIGN)
    read = F.encode(F.translate(value, _OWN, _CONTROLS), "ISO-8859-1").cast("string")
    return F.when(damaged, bind(read, lambda text: F.when(F.is_valid_utf8(text), text).otherwise(value))).otherwise(value)
