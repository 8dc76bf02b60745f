"""Readers, sinks, the relational store and the derived market views."""
