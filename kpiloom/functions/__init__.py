from kpiloom.functions.calendar_es import with_calendar
from kpiloom.functions.numbers import percent_text, ratio, whole
from kpiloom.functions.text import child_label, strip

__all__ = ["child_label", "percent_text", "ratio", "strip", "whole", "with_calendar"]
