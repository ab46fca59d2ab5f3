"""Streaming: intentionally empty.

The reference computes nothing over streams (no watermarks, windows over
event time, or state); every operator here is a batch DataFrame function.
Callers that receive predictions as a stream can run any grouped operator
inside ``foreachBatch`` on each micro-batch's completed runs.
"""
