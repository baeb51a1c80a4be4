"""Plans of the telemetry engine."""

from gantry.plans import queries, replays  # noqa: F401  replays adds its queries to those of ``queries``
