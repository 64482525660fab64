"""The opaque page cursor: base64url of JSON with the last row's time and id.

Times are written to the microsecond, as rows have them, so no row at a page's edge is skipped;
coarser times are read too."""

from __future__ import annotations

import base64
import binascii
import json
import re
from dataclasses import dataclass
from datetime import datetime

from tidelog.functions.timebins import micros, moment

LONGEST = 512


@dataclass(frozen=True)
class Cursor:
    time: int
    id: int


def encode(cursor: Cursor) -> str:
    t = moment(cursor.time).replace(tzinfo=None).isoformat(timespec="microseconds") + "Z"
    return base64.urlsafe_b64encode(json.dumps({"t": t, "i": str(cursor.id)}, separators=(",", ":")).encode()).decode().rstrip("=")


def decode(text: str) -> Cursor | None:
    """None for anything that isn't a cursor."""
    if not 0 < len(text) <= LONGEST:
        return None
    try:
        held = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        time, number = held["t"], held["i"]
        if not (isinstance(time, str) and isinstance(number, str) and re.fullmatch(r"[0-9]+", number)):
            return None
        found = Cursor(micros(datetime.fromisoformat(time)), int(number))
        return found if found.id < 1 << 63 else None
    except (binascii.Error, ValueError, KeyError, TypeError, OverflowError):
        return None
