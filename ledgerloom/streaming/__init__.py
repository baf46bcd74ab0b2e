"""Structured Streaming jobs: file events to messages, messages to invoices, files to landing.

Each job takes what is new and stops, or, with `every` (such as `"1 minute"`), keeps looking for new
files at that interval.
"""


def with_trigger(writer, every=None):
    """Set when a stream looks for new files."""
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
