"""Buffers and clocks over streams."""
