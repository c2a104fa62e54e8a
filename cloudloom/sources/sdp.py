"""Session descriptions: one text for each unit type of a stream."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Media and coding name of each unit type, the clock rate of its time stamps, bytes of a unit's header.
MEDIA = {"AD": ("application", "v3c"), "OVD": ("video", "H265"), "GVD": ("video", "H265"), "AVD": ("video", "H265")}
CLOCK_RATE, HEADER_BYTES = 90000, 4


def description(kind: str, port: int, header: bytes, parameters: bytes, payload_type: int = 96, address: str | None = None) -> str:
    """The text for one unit type; header: of its first unit, parameters: the whole parameter unit, address: where it is sent."""
    media, coding = MEDIA[kind]
    text = lambda b: base64.b64encode(b).decode()
    line = "" if address is None else f"c=IN {'IP6' if ':' in address else 'IP4'} {address}\n"
    return f"m={media} {port} RTP/AVP {payload_type}\n{line}a=rtpmap:{payload_type} {coding}/{CLOCK_RATE}\na=v3cfmtp:sprop-v3c-unit-header={text(header)};\n  sprop-v3c-parameter-set={text(parameters)}"


def descriptions(units: DataFrame, first_port: int = 8890, address: str | None = None) -> DataFrame:
    """(unit_type, name, text) for each type in the first group of units(gof_id, unit_seq, unit_type, payload): four rows at most."""
    first = units.groupBy("unit_type").agg(F.min_by("payload", F.struct("gof_id", "unit_seq")).alias("payload")).collect()
    by = {r["unit_type"]: bytes(r["payload"]) for r in first}
    rows = [(kind, f"V3C_{kind}.sdp", description(kind, first_port + 2 * i, by[kind][:HEADER_BYTES], by.get("VPS", b""), address=address)) for i, kind in enumerate(MEDIA) if kind in by]
    return units.sparkSession.createDataFrame(rows, "unit_type string, name string, text string")
