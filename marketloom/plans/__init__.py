"""Composites: research runs, panel training, live planning, decision cycles, daily reports."""
