"""Readers and writers for transcript, subtitle and report files."""
