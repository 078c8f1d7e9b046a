"""Intake as a stream: collecting new turns, and daily usage that late rows still update."""
