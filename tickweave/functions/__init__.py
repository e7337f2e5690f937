"""Part of the tick-factor engine."""
