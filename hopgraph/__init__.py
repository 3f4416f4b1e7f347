"""Batch jobs that rebuild request traces from captured messages."""
