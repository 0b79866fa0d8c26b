"""The rule catalog: pure functions from fact tables to results, by family."""

from . import calls, classes, data, devices, domain, functions, judgments, modules, records, shapes, statements, suites, surfaces

__all__ = ["calls", "classes", "data", "devices", "domain", "functions", "judgments", "modules", "records", "shapes", "statements", "suites", "surfaces"]
