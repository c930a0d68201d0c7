"""Batch analytics and bulk changes for a venue-booking and staff-operations data set.

Every function takes DataFrames and returns DataFrames.  Clock readings are UTC
``timestamp_ntz`` values and times of day are integer seconds since midnight, so no
result depends on the session time zone.  "Now" is always an argument.
"""
