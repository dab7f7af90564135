"""Golden inputs: the reference's unit-test frame and its 18-row sample CSV."""

# The KPI unit test's two rows and expected figures.
UNIT_ROWS = [("2026-01-15", "M1", 100, 10, 30), ("2026-01-15", "M1", 200, 20, 30)]
UNIT_EXPECTED = {"total_units": 300, "total_defects": 30, "yield_pct": 90.0,
                 "avg_downtime_min": 30.0}

# The shipped sample CSV (3 days x 3 shifts x 2 machines).
SAMPLE_CSV = """Date,Shift,Machine ID,Units Produced,Defective Units,Downtime (minutes)
2026-01-15,Morning,M1,520,12,20
2026-01-15,Morning,M2,480,8,15
2026-01-15,Evening,M1,490,25,40
2026-01-15,Evening,M2,510,10,10
2026-01-15,Night,M1,450,30,60
2026-01-15,Night,M2,470,15,25
2026-01-16,Morning,M1,530,5,10
2026-01-16,Morning,M2,495,12,18
2026-01-16,Evening,M1,510,18,35
2026-01-16,Evening,M2,505,7,12
2026-01-16,Night,M1,440,40,75
2026-01-16,Night,M2,460,20,30
2026-01-17,Morning,M1,550,4,5
2026-01-17,Morning,M2,510,9,15
2026-01-17,Evening,M1,525,15,20
2026-01-17,Evening,M2,520,11,10
2026-01-17,Night,M1,430,45,90
2026-01-17,Night,M2,455,22,40
"""
SAMPLE_SUMS = {"units": 8850, "defects": 308, "downtime": 530}
