"""Fixed values that must equal the modelled application's for right results.

Fixed values (kept verbatim, in natural order):
- SLA hours per severity: Critical 24, High 48, Medium 72, Low 96.
- Miles to km factor: 1.60934.
- Resolution buckets (en dash U+2013): 'Open', '0–4h', '4–24h', '24–72h',
  '3–7 days', '7+ days' with upper bounds 4, 24, 72, 168 hours (inclusive).
- Ticket statuses: New, Assigned, In Progress, Awaiting Parts, Escalated,
  Resolved, Closed.  Severities: Low, Medium, High, Critical.
- Customer segments: Dealer, Fleet Operator, Independent Owner, Service Partner.
- Odometer units: km, miles.
- Forecast horizon: 4 weeks.
"""

from __future__ import annotations

import datetime as _dt

# --- fixed values -----------------------------------------------------------
SLA_HOURS: dict[str, int] = {"Critical": 24, "High": 48, "Medium": 72, "Low": 96}
MILES_TO_KM = 1.60934
BUCKETS: list[tuple[str, int | None]] = [
    ("0–4h", 4),
    ("4–24h", 24),
    ("24–72h", 72),
    ("3–7 days", 168),
    ("7+ days", None),
]
OPEN_BUCKET = "Open"
STATUSES = ["New", "Assigned", "In Progress", "Awaiting Parts", "Escalated", "Resolved", "Closed"]
SEVERITIES = ["Low", "Medium", "High", "Critical"]
SEGMENTS = ["Dealer", "Fleet Operator", "Independent Owner", "Service Partner"]
ODOMETER_UNITS = ["km", "miles"]
FORECAST_WEEKS = 4
# Component -> responsible team routing rules.
ROUTING_RULES: dict[str, str] = {
    "Fuel Injector": "Powertrain Diagnostics",
    "Turbocharger": "Turbo Systems Team",
    "Cooling Pump": "Cooling Systems",
    "Gearbox": "Transmission Engineering",
    "Clutch": "Transmission Engineering",
    "Hydraulic Pump": "Hydraulics Team",
    "Battery": "Electrical Systems",
    "Wiring Harness": "Electrical Systems",
    "Sensors": "Electronics Diagnostics",
    "Brake Pads": "Brake Systems",
    "Hydraulic Line": "Brake Systems",
    "ABS Sensor": "Electronics Diagnostics",
}
# ---------------------------------------------------------------------------

# The reference computes "now" from the wall clock; we take it as a parameter.
# Queries and tests pin it so results are reproducible.
DEFAULT_AS_OF = _dt.datetime(2001, 8, 2, 12, 0, 0)
