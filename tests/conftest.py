from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from salesloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(master="local[*]", shuffle_partitions=8)
    yield session
    session.stop()


def d(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def money(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def qty(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.001"))


# Column order of the hand-made rows in the tests (types from the model).
HEADER_SCHEMA = (
    "VBELN string, FILE_DATE date, AUDAT date, AUART string, KUNNR string, "
    "LFSTK string, GBSTK string, NETWR decimal(18,2), WAERK string"
)
LINE_SCHEMA = (
    "VBELN string, POSNR string, FILE_DATE date, EDATU date, "
    "WMENG decimal(18,3), LMENG decimal(18,3)"
)
